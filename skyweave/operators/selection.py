"""Halo and galaxy selection."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ABUNDANCE, MASS_BINS, TARGET_MASS, UPPER_MASS
from ..sources.scratch import stored


def mass_bin(index: int) -> tuple[float, float]:
    if index not in MASS_BINS:
        raise ValueError(f"no mass bin {index}")
    return MASS_BINS[index]


def binned(halos: DataFrame, index: int, mass: str = "group_mass") -> DataFrame:
    """Strictly inside the bin."""
    low, high = mass_bin(index)
    return halos.where((F.col(mass) > low) & (F.col(mass) < high))


def half_open(halos: DataFrame, index: int, mass: str = "group_mass") -> DataFrame:
    """From the lower edge on, below the upper; -1 has all."""
    if index == -1:
        return halos
    low, high = mass_bin(index)
    return halos.where((F.col(mass) >= low) & (F.col(mass) < high))


def massive(halos: DataFrame, target: float = TARGET_MASS, upper: float | None = UPPER_MASS, mass: str = "group_mass", key: str = "group_id", check: bool = False) -> DataFrame:
    """The most massive objects up to ``upper`` for as long as their running mean stays above ``target``.

    Masses fall along the order, so a prefix's mean falls too and the kept rows are a prefix. With ``check`` a
    ValueError says that all prefixes stay above; a target of the largest mass or more selects nothing. Partial sums
    of ranges of mass come first: no task orders more than its own range.
    """
    rows = halos if upper is None else halos.where(F.col(mass) <= upper)
    rows = rows.where(F.col(mass).isNotNull())
    slim = _ranged(rows, mass, key)
    sums = slim.groupBy("part").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    if check and slim.agg(F.avg("value")).head()[0] is not None and slim.agg(F.avg("value")).head()[0] > target:
        raise ValueError(f"every prefix has a mean mass above {target}")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sums.select("part", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"))
    own = Window.partitionBy("part").orderBy(F.col("value").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    mean = (F.sum("value").over(own) + F.col("s")) / (F.row_number().over(own) + F.col("c"))
    kept = slim.join(F.broadcast(base), "part").withColumn("mean", mean).where(F.col("mean") > F.lit(float(target)))
    return _down_to(rows, kept, mass, key)


def _ranged(rows: DataFrame, value: str, key: str) -> DataFrame:
    """(value, key, part): the objects in ranges of falling value, then key, kept with their ranges' numbers."""
    order = [F.col("value").desc(), F.col("key")]
    return stored(rows.select(F.col(value).alias("value"), F.col(key).alias("key")).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def _down_to(rows: DataFrame, kept: DataFrame, value: str, key: str) -> DataFrame:
    """The rows down to the last of ``kept``, by value and then key: a filter that reaches the files."""
    last = kept.orderBy("value", F.col("key").desc()).limit(1).head()
    if last is None:
        return rows.where(F.lit(False))
    return rows.where((F.col(value) > F.lit(last["value"])) | ((F.col(value) == F.lit(last["value"])) & (F.col(key) <= F.lit(last["key"]))))


def abundance_count(density: float, box: float) -> int:
    return int(density * (box / 1e3) ** 3)


def abundance(objects: DataFrame, box: float, density: float = ABUNDANCE, proxy: str = "subhalo_mstar", key: str = "subhalo_id") -> DataFrame:
    """As many objects as the number density asks for, largest proxy first, ties by id; a null proxy is none.

    Counts of ranges of the proxy tell the range in which the number is reached; only that one is ordered.
    """
    count = abundance_count(density, box)
    rows = objects.where(F.col(proxy).isNotNull())
    slim = _ranged(rows, proxy, key)
    before, found = 0, None
    for part, n in sorted((r["part"], r["count"]) for r in slim.groupBy("part").count().collect()):
        if before + n >= count:
            found = part
            break
        before += n
    if found is None or count <= 0:
        return rows if count > 0 else rows.where(F.lit(False))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("value").desc(), "key"))
    return _down_to(rows, slim.where(F.col("part") == found).withColumn("place", place).where(F.col("place") <= count - before), proxy, key)


def below_parent_mass(subhalos: DataFrame, halos: DataFrame, upper: float = UPPER_MASS) -> DataFrame:
    parents = halos.where(F.col("group_mass") <= upper).select(F.col("group_id").alias("__g"))
    return subhalos.join(parents, F.col("parent_group_id") == F.col("__g"), "left_semi")


def abundance_of_subhalos(subhalos: DataFrame, halos: DataFrame, box: float, density: float = ABUNDANCE, upper: float = UPPER_MASS) -> DataFrame:
    return abundance(below_parent_mass(subhalos, halos, upper), box, density)


def chosen(objects: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A caller's own selection: the objects whose key is in ``ids``."""
    return objects.join(ids.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi")


def select(objects: DataFrame, method: str | None, **kwargs) -> DataFrame:
    if method is None:
        warnings.warn("no selection method is given: mass bin 2 is taken", DeprecationWarning, stacklevel=2)
        return binned(objects, 2)
    methods = {"binned": binned, "massive": massive, "abundance": abundance}
    if method not in methods:
        raise ValueError(f"unknown selection method: {method}")
    return methods[method](objects, **kwargs)


def mean_radius(halos: DataFrame, index: int = 2) -> DataFrame:
    return binned(halos, index).agg(F.avg("group_rad").alias("mean_radius"))


def parent_stats(selected: DataFrame, halos: DataFrame) -> DataFrame:
    """Mean parent mass and radius over selected subhalos, a parent counting once for each."""
    rows = selected.join(halos.select(F.col("group_id").alias("__g"), "group_mass", "group_rad"), F.col("parent_group_id") == F.col("__g"))
    return rows.agg(F.count("*").alias("n"), F.avg("group_mass").alias("mean_mass"), F.avg("group_rad").alias("mean_radius"))


def with_central_flag(subhalos: DataFrame, rtol: float = 1e-5) -> DataFrame:
    """A subhalo is central if its mass is its group's largest, within a relative tolerance."""
    top = subhalos.groupBy(F.col("parent_group_id").alias("__g")).agg(F.max("subhalo_mass").alias("__top"))
    rows = subhalos.join(top, F.col("parent_group_id") == F.col("__g"))
    return rows.withColumn("is_central", F.abs(F.col("subhalo_mass") - F.col("__top")) <= F.lit(1e-8) + F.lit(rtol) * F.col("__top")).drop("__g", "__top")


def selection_stats(selected: DataFrame, subhalos: DataFrame, halos: DataFrame) -> DataFrame:
    """Counts, mean masses, satellite fraction and the mean mass of distinct hosts."""
    flagged = with_central_flag(subhalos).select(F.col("subhalo_id").alias("__s"), "is_central")
    rows = selected.join(flagged, F.col("subhalo_id") == F.col("__s"))
    hosts = rows.select("parent_group_id").distinct().join(halos, F.col("parent_group_id") == F.col("group_id")).agg(F.count("*").alias("n_hosts"), F.avg("group_mass").alias("mean_host_mass"))
    counts = rows.agg(F.count("*").alias("n"), F.avg("subhalo_mass").alias("mean_mass"), F.avg(F.when(F.col("is_central"), 0.0).otherwise(1.0)).alias("satellite_fraction"))
    return counts.crossJoin(hosts)  # one row each


def central_rank(catalogue: DataFrame) -> DataFrame:
    """Position among centrals in row order, -1 before the first; the parent is the host's row, or the row itself."""
    local = stored(catalogue.select("row_id", "is_central", "host_row").repartitionByRange("row_id").withColumn("__part", F.spark_partition_id()))
    centrals = F.sum(F.col("is_central").cast("long"))
    sums = local.groupBy("__part").agg(centrals.alias("s"))
    base = sums.select("__part", F.sum("s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__s"))
    own = centrals.over(Window.partitionBy("__part").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))
    rank = (F.coalesce(own + F.col("__s"), own, F.col("__s")) - 1).alias("central_rank")
    return local.join(F.broadcast(base), "__part").select("row_id", "is_central", rank, F.when(F.col("host_row") >= 0, F.col("host_row")).otherwise(F.col("row_id")).alias("parent_row"))


def finite(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns are neither null, NaN nor infinite."""
    for c in cols:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return rows
