"""Gridding: particles to 2D and 3D fields of cells, stored sparsely as (i, j[, k], value)."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import physics

COMPONENTS = {"total": ("gas", "DM", "Stars", "BH"), "baryon": ("gas", "Stars", "BH")}
SZ = ("tSZ", "kSZ", "tau")
GAS = ("ionized_gas", "neutral_gas", *SZ)


def cell(x: str, box: float, n: int) -> Column:
    """Equal-width bins; the box's far edge belongs to the last."""
    return F.least(F.floor(F.col(x) * F.lit(n) / F.lit(float(box))), F.lit(n - 1)).cast("int")


def of_type(particles: DataFrame, ptype: str) -> DataFrame:
    if ptype in COMPONENTS:
        return particles.where(F.col("ptype").isin(*COMPONENTS[ptype]))
    return particles.where(F.col("ptype") == ("gas" if ptype in GAS else ptype))


def weight(ptype: str, header, projection: str = "xy", n: int | None = None, unit: float = 1e10) -> Column:
    """What a particle adds to its cell."""
    args = (header.box, n or header.n, header.h, header.a)
    makers = {"ionized_gas": lambda: physics.ionized_mass(unit), "neutral_gas": lambda: physics.neutral_mass(unit), "tSZ": lambda: physics.compton_y(*args), "tau": lambda: physics.tau(*args), "kSZ": lambda: physics.ksz(*args, projection)}
    return makers.get(ptype, lambda: physics.mass(unit))()


def nearest_grid(rows: DataFrame, value: Column, box: float, n: int, projection: str = "xy", right_edge: bool = True) -> DataFrame:
    """Sum of values by cell; positions outside the box are dropped, its far edge too without ``right_edge``."""
    x, y = physics.axes(projection)
    top = F.lit(float(box))
    inside = [(F.col(c) >= 0) & ((F.col(c) <= top) if right_edge else (F.col(c) < top)) for c in (x, y)]
    return rows.where(inside[0] & inside[1]).groupBy(cell(x, box, n).alias("i"), cell(y, box, n).alias("j")).agg(F.sum(value).alias("value"))


def field(particles: DataFrame, ptype: str, header, n: int | None = None, projection: str = "xy", unit: float = 1e10) -> DataFrame:
    """The 2D field of a particle type or a composite: one scan, pruned to the columns and types it needs."""
    n = n or header.n
    return nearest_grid(of_type(particles, ptype), weight(ptype, header, projection, n, unit), header.box, n, projection)


def fields(particles: DataFrame, ptypes: list[str], header, n: int | None = None, projection: str = "xy", unit: float = 1e10) -> DataFrame:
    """Several mass fields side by side, a column each, from one scan and one shuffle."""
    n = n or header.n
    x, y = physics.axes(projection)
    sums = []
    for p in ptypes:
        mine = F.col("ptype").isin(*COMPONENTS[p]) if p in COMPONENTS else F.col("ptype") == ("gas" if p in GAS else p)
        sums.append(F.sum(F.when(mine, weight(p, header, projection, n, unit)).otherwise(0.0)).alias(p))
    top = F.lit(header.box)
    rows = particles.where((F.col(x) >= 0) & (F.col(x) <= top) & (F.col(y) >= 0) & (F.col(y) <= top))
    return rows.groupBy(cell(x, header.box, n).alias("i"), cell(y, header.box, n).alias("j")).agg(*sums)


def _tsc_axis(x: str, box: float, n: int) -> tuple[Column, list[Column]]:
    """The nearest cell along an axis, and the weights of the cell below, of it and of the one above."""
    p = F.col(x) / F.lit(float(box)) * F.lit(n)
    i = F.rint(p)
    d = i - p
    low = F.lit(0.5) * (F.lit(0.5) + d) * (F.lit(0.5) + d)
    high = F.lit(0.5) * (F.lit(0.5) - d) * (F.lit(0.5) - d)
    return F.pmod(i.cast("int"), F.lit(n)), [low, F.lit(0.75) - d * d, high]


def tsc_grid(rows: DataFrame, value: Column, box: float, n: int, dims: tuple = ("x", "y", "z")) -> DataFrame:
    """Triangular-shaped-cloud deposit to the 3 cells of each axis, periodic; cell centres at integer coordinates.

    What the particles of a cell give to each of its neighbours is summed first, a column for each neighbour: only
    cells, not particles, are repeated for their neighbours.
    """
    axes = [_tsc_axis(d, box, n) for d in dims]
    names = "ijk"[: len(dims)]
    out = rows.select(value.alias("__v"), *[c.alias(x) for (c, _), x in zip(axes, names, strict=True)], *[w.alias(f"__{x}{a}") for (_, ws), x in zip(axes, names, strict=True) for a, w in enumerate(ws)])
    places = list(product(range(3), repeat=len(dims)))
    shares = {at: reduce(mul, [F.col(f"__{x}{a}") for x, a in zip(names, at, strict=True)], F.col("__v")) for at in places}
    cells = out.groupBy(*names).agg(*[F.sum(w).alias("__s" + "".join(map(str, at))) for at, w in shares.items()])
    near = F.array(*[F.struct(*[F.pmod(F.col(x) + (a - 1), F.lit(n)).alias(x) for x, a in zip(names, at, strict=True)], F.col("__s" + "".join(map(str, at))).alias("value")) for at in places])
    return cells.select(F.explode(near).alias("__c")).select("__c.*").groupBy(*names).agg(F.sum("value").alias("value"))


def nearest_grid_3d(rows: DataFrame, value: Column, box: float, n: int) -> DataFrame:
    return rows.groupBy(*[cell(d, box, n).alias(c) for d, c in zip("xyz", "ijk", strict=True)]).agg(F.sum(value).alias("value"))


def project(field3d: DataFrame, projection: str = "xy") -> DataFrame:
    """Sum along the line of sight."""
    a, b = ({"x": "i", "y": "j", "z": "k"}[d] for d in physics.axes(projection))
    return field3d.groupBy(F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.sum("value").alias("value")).select(F.col("__a").alias("i"), F.col("__b").alias("j"), "value")


def dense(field2d: DataFrame, n: int) -> DataFrame:
    """With a row for every cell; an absent one is 0."""
    spark = field2d.sparkSession
    cells = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    return cells.join(field2d, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))


def subtract_mean(field2d: DataFrame, n: int) -> DataFrame:
    """Less the mean of all n * n cells."""
    mean = field2d.agg((F.coalesce(F.sum("value"), F.lit(0.0)) / F.lit(float(n * n))).alias("__m"))
    return dense(field2d, n).crossJoin(mean).select("i", "j", (F.col("value") - F.col("__m")).alias("value"))


def overdensity(field2d: DataFrame, n: int) -> DataFrame:
    mean = field2d.agg((F.sum("value") / F.lit(float(n * n))).alias("__m"))
    return dense(field2d, n).crossJoin(mean).select("i", "j", (F.try_divide(F.col("value"), F.col("__m")) - 1).alias("value"))


def star_fraction(particles: DataFrame) -> DataFrame:
    s = F.sum(F.when(F.col("ptype") == "Stars", F.col("mass")).otherwise(0.0))
    b = F.sum(F.when(F.col("ptype").isin(*COMPONENTS["baryon"]), F.col("mass")).otherwise(0.0))
    return particles.agg(s.alias("stars"), b.alias("baryons"), F.try_divide(s, b).alias("fraction"))
