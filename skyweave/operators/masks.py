"""Balls and disks around centres as equi-joins over exploded cell offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def centre_cells(objects: DataFrame, box: float, n: int, radius: Column, key: str = "group_id") -> DataFrame:
    """(key, ci, cj, ck, r): each object's cell (half-even rounding) and its radius in cells."""
    at = lambda x: F.rint(F.col(f"pos_{x}") / F.lit(box / n)).cast("int")
    return objects.select(F.col(key), at("x").alias("ci"), at("y").alias("cj"), at("z").alias("ck"), (radius / F.lit(box / n)).alias("r"))


def ball_cells(centres: DataFrame, n: int) -> DataFrame:
    """Every cell of every centre's periodic ball, repeated where a ball meets itself or another.

    Columns i and j are exploded within the bounds that the axes before leave, so no offset outside the ball is made
    but for the corners of the last axis.
    """
    reach = F.ceil("r").cast("int")
    out = centres.withColumn("di", F.explode(F.sequence(-reach, reach)))
    left = lambda *d: F.col("r") * F.col("r") - sum((F.col(x) * F.col(x) for x in d), F.lit(0))
    for d, prev in (("dj", ("di",)), ("dk", ("di", "dj"))):
        out = out.where(left(*prev) >= 0).withColumn("__m", F.floor(F.sqrt(left(*prev))).cast("int")).withColumn(d, F.explode(F.sequence(-F.col("__m"), F.col("__m"))))
    out = out.where(left("di", "dj", "dk") >= 0)
    return out.select(*[c for c in centres.columns if c not in ("ci", "cj", "ck")], *[F.pmod(F.col(f"c{x}") + F.col(f"d{x}"), F.lit(n)).alias(x) for x in "ijk"])


def ball_spans(centres: DataFrame, n: int) -> DataFrame:
    """(i, j, lo, hi): the cells of all balls as disjoint spans along k, in order, each as long as it can be.

    A ball is an interval on each of its lines, so that there is a row for a line and not for a cell. Intervals that
    begin at one cell are one before they are sorted, so a line has a row for each of its cells at most.
    """
    reach = F.ceil("r").cast("int")
    out = centres.withColumn("di", F.explode(F.sequence(-reach, reach)))
    left = lambda *d: F.col("r") * F.col("r") - sum((F.col(x) * F.col(x) for x in d), F.lit(0))
    out = out.where(left("di") >= 0).withColumn("__m", F.floor(F.sqrt(left("di"))).cast("int")).withColumn("dj", F.explode(F.sequence(-F.col("__m"), F.col("__m"))))
    out = out.where(left("di", "dj") >= 0).withColumn("m", F.floor(F.sqrt(left("di", "dj"))).cast("int"))
    lo, last = F.pmod(F.col("ck") - F.col("m"), F.lit(n)), F.lit(n - 1)
    hi = lo + 2 * F.col("m")
    part = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    whole = F.array(part(F.lit(0), last))
    cut = F.when(2 * F.col("m") + 1 >= n, whole).when(hi > last, F.array(part(F.lit(0), hi - n), part(lo, last))).otherwise(F.array(part(lo, hi)))
    line = [F.pmod(F.col("ci") + F.col("di"), F.lit(n)).alias("i"), F.pmod(F.col("cj") + F.col("dj"), F.lit(n)).alias("j")]
    spans = out.select(*line, F.explode(cut).alias("s")).groupBy("i", "j", F.col("s.lo").alias("lo")).agg(F.max("s.hi").alias("hi"))
    order = Window.partitionBy("i", "j").orderBy("lo")
    so_far = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (so_far.isNull() | (F.col("lo") > so_far + 1)).cast("int")
    numbered = spans.withColumn("b", begins).withColumn("b", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("i", "j", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("b")


def _lines(centres: DataFrame, n: int) -> DataFrame:
    """(i, j, spans): a row for each line that a ball meets, with at most half as many spans as cells."""
    return ball_spans(centres, n).groupBy("i", "j").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))


def _inside() -> Column:
    return F.exists("__spans", lambda s: (F.col("k") >= s["lo"]) & (F.col("k") <= s["hi"]))


def ball_mask(centres: DataFrame, n: int) -> DataFrame:
    return ball_spans(centres, n).select("i", "j", F.explode(F.sequence("lo", "hi")).alias("k"))


def disk_mask(centres: DataFrame, n: int) -> DataFrame:
    """2D disks with hard edges: cells beyond the map are dropped, and the range of offsets is rounded down."""
    reach = F.floor("r").cast("int")
    out = centres.withColumn("di", F.explode(F.sequence(-reach, reach))).withColumn("dj", F.explode(F.sequence(-reach, reach)))
    out = out.where(F.col("di") * F.col("di") + F.col("dj") * F.col("dj") <= F.col("r") * F.col("r")).select((F.col("ci") + F.col("di")).alias("i"), (F.col("cj") + F.col("dj")).alias("j"))
    return out.where((F.col("i") >= 0) & (F.col("i") < n) & (F.col("j") >= 0) & (F.col("j") < n)).distinct()


def sums_over_balls(field3d: DataFrame, centres: DataFrame, n: int, keys: list[str], values: list[str]) -> DataFrame:
    """Sum of each value over each centre's ball; a centre without a filled cell has 0."""
    got = ball_cells(centres, n).join(field3d, ["i", "j", "k"]).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    return centres.select(*keys).distinct().join(got, keys, "left").select(*keys, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def masked(field3d: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """The field inside the balls."""
    return field3d.join(_lines(centres, n), ["i", "j"]).where(_inside()).select(*field3d.columns)


def remaining_fraction(field3d: DataFrame, centres: DataFrame, n: int) -> DataFrame:
    """Share of the field outside the balls, by one pass over it."""
    outside = F.col("__spans").isNull() | ~_inside()
    sums = field3d.join(_lines(centres, n), ["i", "j"], "left").agg(F.sum("value").alias("total"), F.coalesce(F.sum(F.when(outside, F.col("value"))), F.lit(0.0)).alias("outside"))
    return sums.select("total", "outside", F.try_divide(F.col("outside"), F.col("total")).alias("fraction"))


#: Particles of a leaf, and how often a cell is halved for them.
LEAF_ROWS, LEVELS = 1 << 14, 8
#: Leaves that are halved, at most: beyond that, leaves have more particles.
HALVED = 1 << 16


def _at(x: Column, box: float, cells: int) -> Column:
    return F.pmod(F.floor(x / F.lit(box / cells)).cast("int"), F.lit(cells))


def leaves(particles: DataFrame, box: float, cells: int, values: tuple = ("mass",)) -> tuple[DataFrame, DataFrame]:
    """Particles with their leaf (level, lx, ly, lz, part), and the leaves (also px, py, pz: the coarse cell) with n and sums.

    Coarse cells with more than LEAF_ROWS particles are halved along each axis, and again. What is still together after
    LEVELS is dealt out by a hash of the row's place to ``part``, so that no leaf is much larger than LEAF_ROWS.
    """
    rows = particles.select("x", "y", "z", *values).withColumn("__row", F.monotonically_increasing_id())
    limit = max(LEAF_ROWS, -(-rows.count() // HALVED))
    names = lambda level: [_at(F.col(a), box, cells << level).alias(f"l{a}") for a in "xyz"]
    key = ["lx", "ly", "lz"]
    split, inside = [], rows
    for level in range(LEVELS + 1):
        many = stored(inside.select(*names(level)).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > limit))
        if not many.count():
            break
        split.append(many)
        inside = inside.select(*rows.columns, *names(level)).join(F.broadcast(many.select(*key)), key, "left_semi").select(*rows.columns)
    placed = rows.withColumns({"level": F.lit(0), "__parts": F.lit(1)})
    for level, many in enumerate(split):  # at most HALVED rows each
        hot = F.broadcast(many.select(*key, "n"))
        placed = placed.select(*rows.columns, "level", "__parts", *names(level)).join(hot, key, "left")
        go = F.col("n").isNotNull() & (F.col("level") == level)
        deeper, parts = (F.col("level"), F.when(go, F.ceil(F.col("n") / limit).cast("int")).otherwise(F.col("__parts"))) if level == LEVELS else (F.when(go, level + 1).otherwise(F.col("level")), F.col("__parts"))
        placed = placed.select(*rows.columns, deeper.alias("level"), parts.alias("__parts"))
    scale = F.shiftleft(F.lit(cells), 0) * F.pow(F.lit(2), F.col("level"))
    own = [F.pmod(F.floor(F.col(a) * scale / F.lit(box)).cast("int"), scale.cast("int")).alias(f"l{a}") for a in "xyz"]
    placed = placed.select("x", "y", "z", *values, "level", *own, F.pmod(F.xxhash64("__row"), F.col("__parts")).cast("int").alias("part"))
    sums = placed.groupBy("level", *key, "part").agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])
    coarse = [F.floor(F.col(f"l{a}") / F.pow(F.lit(2), F.col("level"))).cast("int").alias(f"p{a}") for a in "xyz"]
    return placed, sums.select("*", *coarse)


def particles_in_spheres(particles: DataFrame, objects: DataFrame, box: float, radius: Column, cells: int, key: str = "group_id") -> DataFrame:
    """(key, n, mass) of particles within a radius by minimum-image distance.

    Coarse cells are no smaller than the largest radius, so a sphere touches 27 of them at most; crowded ones are
    halved into leaves (see ``leaves``). A leaf that lies in a sphere as a whole gives its sums, and only those that its
    surface cuts meet it particle by particle.
    """
    placed, known = leaves(particles, box, cells)
    around = F.array(*[F.lit(d) for d in ((-1, 0, 1) if cells >= 3 else range(cells))])
    h = objects.select(key, *[f"pos_{x}" for x in "xyz"], radius.alias("r")).withColumn("__o", F.monotonically_increasing_id())
    h = stored(h)
    spread = h
    for x in "xyz":
        spread = spread.withColumn("__d", F.explode(around)).withColumn(f"p{x}", F.pmod(_at(F.col(f"pos_{x}"), box, cells) + F.col("__d"), F.lit(cells))).drop("__d")
    half = F.lit(box / cells / 2) / F.pow(F.lit(2), F.col("level"))
    apart = []
    for x in "xyz":  # between the centres, and from there to the leaf's near and far side
        d = F.col(f"pos_{x}") - (F.col(f"l{x}") * 2 + 1) * half
        apart.append(F.abs(d - F.lit(box) * F.rint(d / F.lit(box))))
    near = sum((F.pow(F.greatest(d - half, F.lit(0.0)), 2) for d in apart), F.lit(0.0))
    far = sum((F.pow(F.least(d + half, F.lit(box / 2)), 2) for d in apart), F.lit(0.0))
    # a margin: what is close to the sphere is decided particle by particle
    r2 = F.col("r") * F.col("r")
    leaf = ["level", "lx", "ly", "lz", "part"]
    touched = spread.join(known, ["px", "py", "pz"]).where(near <= r2 * (1 + 1e-9)).withColumn("whole", far < r2 * (1 - 1e-9))
    touched = stored(touched.select("__o", *[f"pos_{x}" for x in "xyz"], "r", *leaf, "whole", "n", "mass"))
    d = [F.col(x) - F.col(f"pos_{x}") for x in "xyz"]
    d = [x - F.lit(box) * F.rint(x / F.lit(box)) for x in d]
    cut = touched.where("NOT whole").drop("n", "mass").join(placed, leaf).where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < r2).select("__o", F.lit(1).cast("long").alias("n"), "mass")
    got = touched.where("whole").select("__o", "n", "mass").unionByName(cut).groupBy("__o").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    return h.select(key, "__o").join(got, "__o", "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mass", F.lit(0.0)).alias("mass"))
