"""Stacking: aperture profiles of a field around objects in a periodic box."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from . import filters, masks, tiles


def _around(objects: DataFrame, n: int, box: float, half: int, projection: str, *keep) -> DataFrame:
    """(keep, di, dj, q, i, j): the cells of the square around each object, made where the object is."""
    x, y = physics.axes(projection)
    ci, cj = _cell_of(x, y, box, n)
    reach = F.sequence(F.lit(-half), F.lit(half))
    placed = objects.select(*keep, ci.alias("ci"), cj.alias("cj")).withColumn("di", F.explode(reach)).withColumn("dj", F.explode(reach))
    q = F.col("di") * F.col("di") + F.col("dj") * F.col("dj")
    names = [c if isinstance(c, str) else placed.columns[k] for k, c in enumerate(keep)]
    return placed.select(*names, "di", "dj", q.alias("q"), F.pmod(F.col("ci") + F.col("di"), F.lit(n)).alias("i"), F.pmod(F.col("cj") + F.col("dj"), F.lit(n)).alias("j"))


def _cell_of(x: str, y: str, box: float, n: int) -> list:
    return [F.rint(F.col(f"pos_{c}") / F.lit(box / n)).cast("int") for c in (x, y)]


def shells(field: DataFrame, objects: DataFrame, n: int, box: float, half: int, projection: str = "xy", key: str = "group_id", values: tuple = ("value",)) -> DataFrame:
    """(key, q, values): sums of the field by squared offset from each object's pixel, within the square.

    The one large join of a stack. It is by cell and has no radius in it, so that all filters and radii share it; a
    field with several columns serves several particle types at once.
    """
    cells = _around(objects, n, box, half, projection, key).select(key, "q", "i", "j")
    return cells.join(field, ["i", "j"]).groupBy(key, "q").agg(*[F.sum(v).alias(v) for v in values])


def pixels(field: DataFrame, objects: DataFrame, n: int, box: float, half: int, step: float, projection: str = "xy", key: str = "group_id") -> DataFrame:
    """(object_id, di, dj, r, tie, value) of each object's cutout, empty pixels as 0."""
    cells = _around(objects, n, box, half, projection, F.col(key).alias("object_id"))
    return cells.join(field, ["i", "j"], "left").select("object_id", "di", "dj", (F.sqrt("q") * F.lit(step)).alias("r"), ((F.col("di") + half) * (2 * half + 1) + F.col("dj") + half).alias("tie"), F.coalesce("value", F.lit(0.0)).alias("value"))


#: Above so many pixels around an object (or rows of a weight table) nothing is built for each of them on the driver or joined.
PIXELS, TABLE_ROWS = 1 << 20, 1 << 18
#: Rows of the join by offsets that cost as much as one cell's share in a transform.
ROWS_A_CELL = 2


def profiles(field: DataFrame, objects: DataFrame, n: int, box: float, filter_type: str | Callable, radii, unit: float, projection: str = "xy", key: str = "group_id", pixel: float = 1.0, dr: float | None = None, values: tuple = ("value",), edges=None, way: str | None = None) -> DataFrame:
    """(key, radius, values): one filter's profile of each object. An object over empty cells has zeros.

    ``unit`` is the radius unit in the field's length unit; ``pixel`` the pixel's size for surface densities; ``dr`` the
    width of an excess's ring, three pixels unless given. The running excess takes ``edges`` of its bins; a bin without
    pixels is null.

    There are two ways: objects meet the pixels around them ("offsets"), or the whole field is correlated with each
    radius's weights once, and objects look up their own pixel ("maps"). Unless given, the one with fewer rows is taken.
    """
    per_unit = unit / (box / n)
    if filter_type == "DSigma" and dr is None:
        dr = 3 / per_unit
    kernels = filters.Kernels.of(filter_type, radii, per_unit, pixel, dr, edges)
    if way is None:
        way = _cheaper(objects, kernels, n)
    by = {"offsets": _by_offsets, "maps": _by_maps}[way](field, objects, n, box, kernels, projection, key, values)
    spark = field.sparkSession
    every = objects.select(key).distinct().crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in kernels.radii], "radius double")))
    zero = F.when(~F.col("radius").isin(*none), 0.0) if (none := kernels.empty()) else F.lit(0.0)
    return every.join(by, [key, "radius"], "left").select(key, "radius", *[F.coalesce(v, zero).alias(v) for v in values])


def _cheaper(objects: DataFrame, kernels: filters.Kernels, n: int) -> str:
    """Objects times offsets against cells times radii, each with its share of a transform."""
    if kernels.pixels > PIXELS or (not kernels.by_distance and kernels.pixels * len(kernels.radii) > TABLE_ROWS):
        return "maps"
    enough = int(ROWS_A_CELL * len(kernels.radii) * n * n * np.log2(max(2, n)) / kernels.pixels)
    return "maps" if objects.limit(enough + 1).count() > enough else "offsets"


def _by_offsets(field: DataFrame, objects: DataFrame, n: int, box: float, kernels: filters.Kernels, projection: str, key: str, values: tuple) -> DataFrame:
    table = F.broadcast(kernels.table(field.sparkSession))  # TABLE_ROWS, or a row for each distance of PIXELS and radius
    if kernels.by_distance:
        rows = shells(field, objects, n, box, kernels.geometry.half, projection, key, values).join(table, "q")
    else:
        rows = _around(objects, n, box, kernels.geometry.half, projection, key).join(field, ["i", "j"]).join(table, ["di", "dj"])
    return rows.groupBy(key, "radius").agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])


def _by_maps(field: DataFrame, objects: DataFrame, n: int, box: float, kernels: filters.Kernels, projection: str, key: str, values: tuple) -> DataFrame:
    x, y = physics.axes(projection)
    at = objects.select(key, *[F.pmod(c, F.lit(n)).alias(i) for c, i in zip(_cell_of(x, y, box, n), "ij", strict=True)])
    told = F.broadcast(field.sparkSession.createDataFrame(list(enumerate(kernels.radii)), "r int, radius double"))
    out, none = None, set(kernels.empty())
    for v in values:
        maps = tiles.correlated(tiles.filled(field, (n, n), v), lambda r: np.nan_to_num(kernels.square(r)), len(kernels.radii))
        found = tiles.looked_up(maps, at).join(told, "r").where(~F.col("radius").isin(*none) if none else F.lit(True))
        rows = at.join(found, ["i", "j"]).groupBy(key, "radius").agg(F.sum("value").alias(v))
        out = rows if out is None else out.join(rows, [key, "radius"])
    return out


def linear_radii(low: float, high: float, count: int) -> np.ndarray:
    return np.linspace(low, high, count)


def sphere_profiles(field3d: DataFrame, objects: DataFrame, n: int, box: float, radii, unit: float | None = None, key: str = "group_id", values: tuple = ("value",)) -> DataFrame:
    """(key, radius, values): sums in balls of growing radius, in units of ``unit`` or of the object's own radius.

    Objects of one cell and radius share a ball. Its cells are joined once and counted to the first radius that holds
    them, objects look the shells up, and a running sum over radii gives every ball. A ball's cells are many more than
    Spark's estimate, which takes an exploded row for one, so that join is by sorting and sends no side whole; so is the
    look-up, whose shells grow with the objects.
    """
    radii = sorted(float(r) for r in radii)
    own = F.col("group_rad") if unit is None else F.lit(float(unit))
    at = ["ci", "cj", "ck", "r"]
    placed = masks.centre_cells(objects, box, n, own * F.lit(radii[-1]), key).withColumns({c: F.pmod(c, F.lit(n)) for c in at[:3]})
    spark = field3d.sparkSession
    cells = _cells_with_distance(placed.select(*at).distinct(), n)
    first = F.lit(len(radii) - 1)
    for i in reversed(range(len(radii) - 1)):
        first = F.when(F.col("d2") <= (F.col("r") * F.lit(radii[i] / radii[-1])) * (F.col("r") * F.lit(radii[i] / radii[-1])), F.lit(i)).otherwise(first)
    got = cells.withColumn("shell", first).join(field3d.hint("merge"), ["i", "j", "k"]).groupBy(*at, "shell").agg(*[F.sum(v).alias(v) for v in values])
    shells_ = F.broadcast(spark.createDataFrame(list(enumerate(radii)), "shell int, radius double"))
    every = placed.crossJoin(shells_).join(got.hint("merge"), [*at, "shell"], "left").groupBy(key, "shell", "radius").agg(*[F.sum(F.coalesce(v, F.lit(0.0))).alias(v) for v in values])
    upto = Window.partitionBy(key).orderBy("shell").rowsBetween(Window.unboundedPreceding, 0)
    return every.select(key, "radius", *[F.sum(v).over(upto).alias(v) for v in values])


def _cells_with_distance(balls: DataFrame, n: int) -> DataFrame:
    """(ci, cj, ck, r, d2, i, j, k): the cells of each ball, with their squared distance."""
    reach = F.ceil("r").cast("int")
    out = balls.withColumn("di", F.explode(F.sequence(-reach, reach)))
    left = lambda *d: F.col("r") * F.col("r") - sum((F.col(x) * F.col(x) for x in d), F.lit(0))
    for d, prev in (("dj", ("di",)), ("dk", ("di", "dj"))):
        out = out.where(left(*prev) >= 0).withColumn("__m", F.floor(F.sqrt(left(*prev))).cast("int")).withColumn(d, F.explode(F.sequence(-F.col("__m"), F.col("__m"))))
    d2 = F.col("di") * F.col("di") + F.col("dj") * F.col("dj") + F.col("dk") * F.col("dk")
    return out.where(left("di", "dj", "dk") >= 0).select(*balls.columns, d2.alias("d2"), *[F.pmod(F.col(f"c{x}") + F.col(f"d{x}"), F.lit(n)).alias(x) for x in "ijk"])


def shell_profile(cumulative: DataFrame, key: str = "group_id", value: str = "value") -> DataFrame:
    """Shells between consecutive edges by differencing."""
    w = Window.partitionBy(key).orderBy("radius")
    return cumulative.select(key, F.col("radius").alias("inner"), F.lead("radius").over(w).alias("outer"), (F.lead(value).over(w) - F.col(value)).alias(value)).where(F.col("outer").isNotNull())
