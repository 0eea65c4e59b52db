"""Statistics over objects: profiles with errors, ratios, compositions, covariances and significance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored

def mean_profile(profiles: DataFrame, value: str = "value", by: tuple = ("radius",)) -> DataFrame:
    """Mean and standard error (population deviation over root n)."""
    return profiles.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("err"), F.count(value).alias("n"))


def _relative(m: str, e: str):
    return F.pow(F.try_divide(F.col(e), F.col(m)), 2)


def ratio(one: DataFrame, two: DataFrame, f_b: float = 1.0) -> DataFrame:
    """Ratio of two mean profiles over the baryon fraction, errors in quadrature; null where a mean is 0."""
    a = one.select("radius", F.col("mean").alias("m0"), F.col("err").alias("e0"))
    b = two.select("radius", F.col("mean").alias("m1"), F.col("err").alias("e1"))
    r = F.try_divide(F.col("m0"), F.col("m1")) / F.lit(f_b)
    return a.join(b, "radius").select("radius", r.alias("ratio"), (F.abs(r) * F.sqrt(_relative("m0", "e0") + _relative("m1", "e1"))).alias("err"))


def double_ratio(a: DataFrame, b: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    """(A/B) / (C/D) with a four-term error."""
    rows = None
    for i, p in enumerate((a, b, c, d)):
        p = p.select("radius", F.col("mean").alias(f"m{i}"), F.col("err").alias(f"e{i}"))
        rows = p if rows is None else rows.join(p, "radius")
    r = F.try_divide(F.try_divide(F.col("m0"), F.col("m1")), F.try_divide(F.col("m2"), F.col("m3")))
    return rows.select("radius", r.alias("ratio"), (F.abs(r) * F.sqrt(sum((_relative(f"m{i}", f"e{i}") for i in range(1, 4)), _relative("m0", "e0")))).alias("err"))


#: Ranges that a group's values are cut into at a time, and rows of a range that one task may sort.
RANGES, RANGE_ROWS = 64, 1 << 17
#: Groups whose ranges are broadcast.
TOLD_GROUPS = 1 << 12


def quantiles(rows: DataFrame, probabilities: list[float], value: str = "value", by: tuple = ("radius",)) -> DataFrame:
    """(by, q): exact quantiles of each group by linear interpolation, as an array; null values don't count.

    Values are counted by ranges, and only the ranges that hold a wanted place are looked at again, cut finer as long as
    one has more than RANGE_ROWS rows of different values. No task has all rows of a group, however large.
    """
    keys = list(by)
    left = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), F.lit(0).cast("long").alias("range"))
    # the places of a group's quantiles, from 0: two each, between which it is interpolated
    number = left.groupBy(*keys).agg(F.count("*").alias("n"))
    at = (F.col("n") - 1) * F.col("p")
    wanted = number.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    wanted = stored(wanted.select(*keys, "p", "side", F.lit(0).cast("long").alias("range"), F.when(F.col("side") == 0, F.floor(at)).otherwise(F.ceil(at)).cast("long").alias("place"), (at - F.floor(at)).alias("share")))
    told = F.broadcast if wanted.count() <= 2 * len(probabilities) * TOLD_GROUPS else (lambda x: x)
    while True:
        cuts = [(i + 1) / RANGES for i in range(RANGES - 1)]
        about = stored(left.groupBy(*keys, "range").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", cuts, RANGES * 100).alias("cuts")))
        largest = about.where("low < high").agg(F.max("n")).first()[0] or 0
        if largest <= RANGE_ROWS:
            break
        # a cut's own value is a range of its own, so that every range of different values becomes smaller
        finer = left.join(told(about.select(*keys, "range", "cuts")), [*keys, "range"]).select(*keys, "v", "range", (F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.size(F.filter("cuts", lambda c: c <= F.col("v")))).alias("finer"))
        before = Window.partitionBy(*keys, "range").orderBy("finer").rowsBetween(Window.unboundedPreceding, -1)
        counted = finer.groupBy(*keys, "range", "finer").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        inside = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
        held = counted.join(told(wanted), [*keys, "range"]).where(inside).withColumn("next", F.dense_rank().over(Window.partitionBy(*keys).orderBy("range", "finer")).cast("long"))
        held = stored(held.select(*keys, "range", "finer", "next", "p", "side", (F.col("place") - F.col("before")).alias("place"), "share"))
        wanted = held.select(*keys, F.col("next").alias("range"), "p", "side", "place", "share")
        few = finer.join(told(held.select(*keys, "range", "finer", "next").distinct()), [*keys, "range", "finer"])
        old, left = left, stored(few.select(*keys, "v", F.col("next").alias("range")))
        discard(old)
    upto = Window.partitionBy(*keys, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    each = left.groupBy(*keys, "range", "v").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(upto))
    found = each.join(told(wanted), [*keys, "range"]).where((F.col("place") < F.col("end")) & (F.col("place") >= F.col("end") - F.col("n")))
    low, high = (F.max(F.when(F.col("side") == x, F.col("v"))) for x in (0, 1))
    one = found.groupBy(*keys, "p").agg(low.alias("low"), high.alias("high"), F.max("share").alias("share")).withColumn("q", F.when(F.col("share") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("share")))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("p", "q"))).alias("m")).select(*keys, F.array(*[F.col("m")[F.lit(float(p))] for p in probabilities]).alias("q"))


def quartiles(profiles: DataFrame, value: str = "value", by: tuple = ("radius",)) -> DataFrame:
    """Exact quartiles with linear interpolation."""
    return quantiles(profiles, [0.25, 0.5, 0.75], value, by).select(*by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def composition(means: DataFrame) -> DataFrame:
    """(radius, ptype, fraction) from (radius, ptype, mean): shares of the sum, null where the sum is 0."""
    return means.select("radius", "ptype", F.try_divide(F.col("mean"), F.sum("mean").over(Window.partitionBy("radius"))).alias("fraction"))


def beam_factor(per_sim: DataFrame) -> DataFrame:
    """(radius, factor, scatter, n) from (sim, radius, beamed, bare): each sim's ratio counts once, scatter with ddof 1."""
    r = per_sim.groupBy("sim", "radius").agg(F.try_divide(F.avg("beamed"), F.avg("bare")).alias("r"))
    return r.groupBy("radius").agg(F.avg("r").alias("factor"), F.stddev_samp("r").alias("scatter"), F.count("r").alias("n"))


def covariance(samples: DataFrame, key: str = "sim", index: str = "radius", value: str = "value") -> DataFrame:
    """(i, j, cov) with ddof 1 over the samples that have both."""
    a = samples.select(F.col(key).alias("s"), F.col(index).alias("i"), F.col(value).alias("a"))
    b = samples.select(F.col(key).alias("t"), F.col(index).alias("j"), F.col(value).alias("b"))
    return a.join(b, F.col("s") == F.col("t")).groupBy("i", "j").agg(F.covar_samp("a", "b").alias("cov"))


def compensate(cov: DataFrame, factor: DataFrame, ratio: DataFrame | None = None, factor_cov: DataFrame | None = None) -> DataFrame:
    """Covariance of a measurement divided by a beam factor.

    With the measurement's values (radius, ratio) and the factor's own covariance (i, j, cov) over simulations, its
    scatter is added, by the derivative ratio / factor ** 2.
    """
    f = factor.select("radius", "factor")
    a, b = f.select(F.col("radius").alias("i"), F.col("factor").alias("fi")), f.select(F.col("radius").alias("j"), F.col("factor").alias("fj"))
    rows = cov.join(a, "i").join(b, "j")
    total = F.try_divide(F.col("cov"), F.col("fi") * F.col("fj"))
    if factor_cov is not None:
        values = ratio.select(F.col("radius").alias("i"), F.col("ratio").alias("ri")), ratio.select(F.col("radius").alias("j"), F.col("ratio").alias("rj"))
        rows = rows.join(values[0], "i").join(values[1], "j").join(factor_cov.select("i", "j", F.col("cov").alias("fc")), ["i", "j"])
        total = total + F.try_divide(F.col("ri") * F.col("rj") * F.col("fc"), F.col("fi") * F.col("fi") * F.col("fj") * F.col("fj"))
    return rows.select("i", "j", total.alias("cov"))


def compensated(data: DataFrame, factor: DataFrame) -> DataFrame:
    """(radius, value) of a measurement over its beam factor."""
    return data.join(factor.select("radius", "factor"), "radius").select("radius", F.try_divide(F.col("value"), F.col("factor")).alias("value"))


def hartlap_factor(n_resample: int, n_bins: int) -> float:
    if n_resample <= n_bins + 2:
        raise ValueError(f"the correction needs more than {n_bins + 2} resamplings, not {n_resample}")
    return (n_resample - n_bins - 2) / (n_resample - 1)


def apply_hartlap(cov: DataFrame, n_resample: int, n_bins: int) -> DataFrame:
    return cov.withColumn("cov", F.col("cov") / F.lit(hartlap_factor(n_resample, n_bins)))


def matrix(cov: DataFrame) -> tuple[list, np.ndarray]:
    """The dense matrix of a covariance of a few dozen bins."""
    rows = cov.collect()
    names = sorted({r["i"] for r in rows})
    at = {x: k for k, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = r["cov"]
    return names, m


def detection_snr(data, cov: np.ndarray, null: float = 0.0) -> float:
    d = np.asarray(data, float) - null
    return float(np.sqrt(d @ np.linalg.inv(cov) @ d))


def chi2_tail(x: float, dof: int) -> float:
    """Survival function of the chi-squared distribution, by recurrence over half-integers."""
    from math import erfc, exp, gamma, sqrt

    h = x / 2
    q, a = (exp(-h), 1.0) if dof % 2 == 0 else (erfc(sqrt(h)), 0.5)
    while a < dof / 2 - 1e-9:
        q += h**a * exp(-h) / gamma(a + 1)
        a += 1
    return q


def null_test(data, cov: np.ndarray) -> dict[str, float]:
    d = np.asarray(data, float)
    x = float(d @ np.linalg.inv(cov) @ d)
    return {"chi2": x, "dof": len(d), "pte": chi2_tail(x, len(d))}
