"""Every registered query of the stacking engine, against its SQL where it has one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import selection
from skyweave.plans import registry

from .conftest import DATA

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(name, spark):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_significance_against_numpy(spark):
    """From the profiles of every object, which have SQL of their own."""
    rows = registry._stack(spark, DATA, "cumulative").collect()
    radii = sorted({r["radius"] for r in rows})
    sims = sorted({r["group_id"] % registry.SAMPLES for r in rows})
    means = np.array([[np.mean([r["value"] for r in rows if r["group_id"] % registry.SAMPLES == s and r["radius"] == x]) for x in radii] for s in sims])
    cov = np.cov(means.T, ddof=1) * (len(sims) - 1) / (len(sims) - len(radii) - 2)
    mean = means.mean(axis=0)
    chi2 = mean @ np.linalg.solve(cov, mean)
    got = registry.queries()["detection_snr"](spark, DATA).head()
    assert len(sims) > len(radii) + 2 and got["dof"] == len(radii)
    assert np.isclose(got["chi2"], chi2) and np.isclose(got["snr"], np.sqrt(chi2)) and 0 <= got["pte"] < 1


def test_bias_fields_against_numpy(spark):
    """From the particles, by a deposit of loops."""
    n, box = registry._PK_N, registry.H.box
    grid, at = np.zeros((n,) * 3), np.array([r[:] for r in registry._p(spark, DATA).where("ptype = 'DM'").select("x", "y", "z", "mass").collect()])
    p = at[:, :3] / box * n
    near = np.rint(p).astype(int)
    for s in np.ndindex(3, 3, 3):
        w = np.ones(len(p))
        for a in range(3):
            d = near[:, a] - p[:, a]
            w *= (0.5 * (0.5 + d) ** 2, 0.75 - d * d, 0.5 * (0.5 - d) ** 2)[s[a]]
        np.add.at(grid, tuple((near[:, a] + s[a] - 1) % n for a in range(3)), at[:, 3] * w)
    f = 2 * np.pi * np.fft.fftfreq(n, box / 1e3 / n)
    f[n // 2] = -np.pi * n / (box / 1e3)
    k = np.meshgrid(f, f, f, indexing="ij")
    q = sum(x * x for x in k)
    modes = np.fft.fftn(grid / grid.mean()) * np.exp(-q / (2 * 0.4**2))
    delta, s2 = np.fft.ifftn(modes).real, 0
    with np.errstate(invalid="ignore", divide="ignore"):
        for x in range(3):
            for y in range(3):
                s2 = s2 + np.fft.ifftn(modes * np.where(q > 0, k[x] * k[y] / q - (x == y) / 3, 0)).real ** 2
    want = {"delta": delta - delta.mean(), "delta2": delta**2 - (delta**2).mean(), "s2": s2 - s2.mean(), "nabla2": np.fft.ifftn(-q * modes).real}
    rows = registry.queries()["bias_fields"](spark, DATA).collect()
    assert len(rows) == n**3
    for r in rows:
        assert all(np.isclose(r[x], want[x][r["i"], r["j"], r["k"]], atol=1e-8) for x in want)


def test_central_rank_in_several_tasks(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS row_id").selectExpr("row_id", "row_id % 3 = 1 AS is_central", "IF(row_id % 3 = 1, -1, 1) AS host_row")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = selection.central_rank(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(key, held)
    assert sorted((r["row_id"], r["central_rank"]) for r in got) == [(i, (i + 2) // 3 - 1) for i in range(1000)]
    assert len({r["task"] for r in got}) > 1
