"""Quantiles, spheres and balls where most rows are in one place, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import masks, stack, stats

BOX = 100.0


@pytest.mark.parametrize("rows", [1 << 17, 200])
def test_quantiles(spark, monkeypatch, rows):
    monkeypatch.setattr(stats, "RANGE_ROWS", rows)
    r = np.random.default_rng(1)
    groups = {1.0: r.normal(size=3000) * 10.0 ** r.integers(-3, 4, 3000), 2.0: np.repeat([4.0, 4.5, 7.0], [900, 1, 600]), 3.0: np.array([5.0]), 4.0: np.concatenate((np.full(2000, 0.0), r.random(1500))), 5.0: np.array([1.0, 2.0])}
    table = spark.createDataFrame([(k, float(x), "v") for k, own in groups.items() for x in own] + [(6.0, None, "n"), (1.0, None, "n")], "radius double, value double, q string").repartition(5)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {x["radius"]: x["q"] for x in stats.quantiles(table, probabilities).collect()}
    assert got.keys() == groups.keys()
    for k, own in groups.items():
        assert np.allclose(got[k], np.quantile(own, probabilities), rtol=1e-12, atol=0)
    assert stats.quantiles(table.where("false"), probabilities).count() == 0
    three = {x["radius"]: (x["q25"], x["median"], x["q75"]) for x in stats.quartiles(table).collect()}
    assert all(np.allclose(three[k], np.quantile(own, [0.25, 0.5, 0.75])) for k, own in groups.items())


def test_only_some_ranges_are_sorted(spark, monkeypatch):
    """What is ranked at the end is a small part of a group."""
    monkeypatch.setattr(stats, "RANGE_ROWS", 500)
    seen = []
    held = stats.stored
    monkeypatch.setattr(stats, "stored", lambda df: seen.append(held(df)) or seen[-1])
    stats.quartiles(spark.range(40_000).select(F.lit(1).alias("radius"), (F.col("id") * 7919 % 40_000).cast("double").alias("value"))).collect()
    kept = [df for df in seen if "v" in df.columns]
    assert kept and all(df.groupBy("range").count().agg(F.max("count")).first()[0] < 1500 for df in kept[-1:])


def inside(p, centre, r):
    d = p - centre
    d -= BOX * np.rint(d / BOX)
    return (d**2).sum(axis=1) < r * r


@pytest.mark.parametrize("crowd,cells", [("cell", 7), ("point", 2)])
def test_spheres_in_a_crowd(spark, monkeypatch, crowd, cells):
    """Half of the particles are in one cell, or at one point."""
    monkeypatch.setattr(masks, "LEAF_ROWS", 100)
    r = np.random.default_rng(2)
    n = 3000
    p = r.random((n, 3)) * BOX
    p[: n // 2] = np.array([3.0, 98.0, 50.0]) + (r.random((n // 2, 3)) - 0.5) * (4.0 if crowd == "cell" else 0.0)
    p %= BOX
    mass = r.integers(1, 50, n).astype(float)
    rows = spark.createDataFrame([(*map(float, x), float(m)) for x, m in zip(p, mass, strict=True)], "x double, y double, z double, mass double").repartition(4)
    centres = [(i, *map(float, r.random(3) * BOX), float(r.random() * BOX / max(cells, 3))) for i in range(25)] + [(100, 3.0, 98.0, 50.0, 1.0), (101, 2.0, 99.0, 51.0, 8.0), (102, 3.0, 98.0, 50.0, 0.0), (100, 60.0, 60.0, 60.0, 5.0)]
    objects = spark.createDataFrame(centres, "group_id long, pos_x double, pos_y double, pos_z double, rad double")
    got = sorted((x["group_id"], x["n"], x["mass"]) for x in masks.particles_in_spheres(rows, objects, BOX, F.col("rad"), cells).collect())
    want = []
    for i, *at, rad in centres:
        on = inside(p, np.array(at), rad)
        want.append((i, int(on.sum()), float(mass[on].sum())))
    assert got == sorted(want)
    _, known = masks.leaves(rows, BOX, cells)
    sizes = [x["n"] for x in known.select("n").collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * 100  # a hash deals out what can't be halved


@pytest.mark.parametrize("n", [9])
def test_spans_of_balls(spark, n):
    """Spans are the cells of the balls, disjoint, and with a gap between any two."""
    r = np.random.default_rng(3)
    rows = [(i, int(a), int(b), int(c), float(s)) for i, (a, b, c, s) in enumerate(zip(r.integers(0, n + 1, 12), r.integers(0, n + 1, 12), r.integers(0, n + 1, 12), r.choice([0.0, 1.0, 1.7, 2.5, n * 0.7], 12), strict=True))]
    want = set()
    for _, a, b, c, s in rows:
        reach = int(np.ceil(s))
        d = np.arange(-reach, reach + 1)
        for x, y, z in np.argwhere(d[:, None, None] ** 2 + d[None, :, None] ** 2 + d[None, None, :] ** 2 <= s * s) - reach:
            want.add(((a + x) % n, (b + y) % n, (c + z) % n))
    centres = spark.createDataFrame(rows, "group_id long, ci int, cj int, ck int, r double").repartition(3)
    spans = [tuple(x) for x in masks.ball_spans(centres, n).select("i", "j", "lo", "hi").collect()]
    assert {(i, j, k) for i, j, lo, hi in spans for k in range(lo, hi + 1)} == want and sum(hi - lo + 1 for *_, lo, hi in spans) == len(want)
    lines = {}
    for i, j, lo, hi in spans:
        lines.setdefault((i, j), []).append((lo, hi))
    assert all(b[0] > a[1] + 1 for own in lines.values() for a, b in zip(sorted(own)[:-1], sorted(own)[1:], strict=True))
    assert {tuple(x) for x in masks.ball_mask(centres, n).collect()} == want and masks.ball_mask(centres, n).count() == len(want)
    field = spark.createDataFrame([(i, j, k, 1.0) for i in range(n) for j in range(n) for k in range(n)], "i int, j int, k int, value double")
    assert {tuple(x[:3]) for x in masks.masked(field, centres, n).collect()} == want
    got = masks.remaining_fraction(field, centres, n).head()
    assert (got["total"], got["outside"]) == (n**3, n**3 - len(want))
    none = masks.remaining_fraction(field, centres.where("false"), n).head()
    assert none["fraction"] == 1.0


def test_fewer_rows_before_the_union(spark):
    """A ball of radius r has about r^2 lines and r^3 cells."""
    centres = spark.createDataFrame([(1, 20, 20, 20, 9.0)], "group_id long, ci int, cj int, ck int, r double")
    assert masks.ball_spans(centres, 40).count() * 9 < masks.ball_cells(centres, 40).count()


def test_shells_send_no_exploded_cells(spark):
    """The cells of all balls are many times Spark's estimate of them: the driver must not gather them for a broadcast."""
    n = 20
    objects = spark.range(500).select(F.col("id").alias("group_id"), *[(F.col("id") * m % 100).cast("double").alias(f"pos_{x}") for x, m in zip("xyz", (7, 11, 13), strict=True)])
    field = spark.range(n**3).selectExpr("CAST(id % 20 AS INT) AS i", "CAST(id DIV 20 % 20 AS INT) AS j", "CAST(id DIV 400 AS INT) AS k", "1.0D AS value")
    radii = [2.0, 6.0, 16.0]
    got = stack.shell_profile(stack.sphere_profiles(field, objects, n, BOX, radii, 1.0))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    d = np.arange(-4, 5)
    q = d[:, None, None] ** 2 + d[None, :, None] ** 2 + d[None, None, :] ** 2
    balls = [int((q <= (r / BOX * n) ** 2).sum()) for r in radii]
    rows = got.collect()
    assert len(rows) == 2 * 500 and {(r["inner"], r["outer"], r["value"]) for r in rows} == {(2.0, 6.0, balls[1] - balls[0]), (6.0, 16.0, balls[2] - balls[1])}


def test_spheres_send_no_shells(spark):
    """A table that proves small while it runs may still be broadcast: the balls' shells grow with the objects."""
    n = 20
    objects = spark.range(2000).select(F.col("id").alias("group_id"), *[(F.col("id") * m % 100).cast("double").alias(f"pos_{x}") for x, m in zip("xyz", (7, 11, 13), strict=True)])
    field = spark.range(n**3).selectExpr("CAST(id % 20 AS INT) AS i", "CAST(id DIV 20 % 20 AS INT) AS j", "CAST(id DIV 400 AS INT) AS k", "1.0D AS value")
    got = stack.sphere_profiles(field, objects, n, BOX, [2.0, 6.0], 1.0)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == 2 * 2000 and set(rows) == {(i, r, v) for i in range(2000) for r, v in ((2.0, 1.0), (6.0, 7.0))}
    final, _ = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")
    assert "isFinalPlan=true" in final and "BroadcastHashJoin" not in final


@pytest.mark.parametrize("unit", [1.0, None])
def test_spheres_of_one_cell_share_a_ball(spark, monkeypatch, unit):
    """300 objects of one cell explode one ball; an object without a key or a place, or listed twice, has its rows."""
    n, radii = 20, [0.6, 1.0] if unit is None else [6.0, 10.0]
    r = np.random.default_rng(4)
    field = r.integers(1, 9, (n, n, n)).astype(float)
    rows = spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(field)], "i int, j int, k int, value double")
    crowd = [(i, 99.0, 1.0, 50.0, 10.0) for i in range(300)]
    odd = [(300, 40.0, 40.0, 40.0, 10.0), (300, 60.0, 10.0, 20.0, 10.0), (None, 70.0, 70.0, 70.0, 10.0), (301, None, 1.0, 1.0, 10.0)]
    objects = spark.createDataFrame(crowd + odd, "group_id long, pos_x double, pos_y double, pos_z double, group_rad double")
    made, held = [], stack._cells_with_distance
    monkeypatch.setattr(stack, "_cells_with_distance", lambda *a: made.append(held(*a)) or made[-1])
    got = [(x["group_id"], x["radius"], x["value"]) for x in stack.sphere_profiles(rows, objects, n, BOX, radii, unit).collect()]
    d = np.arange(-2, 3)
    want = {(key, x): 0.0 for key, *_ in crowd + odd for x in radii}
    for key, *at, own in crowd + odd:
        if None not in at:
            near = np.rint(np.array(at) / BOX * n).astype(int)
            around = field[np.ix_(*[(c + d) % n for c in near])]
            for x in radii:
                want[key, x] += around[d[:, None, None] ** 2 + d[None, :, None] ** 2 + d[None, None, :] ** 2 <= (x * (unit or own) / BOX * n) ** 2].sum()
    assert len(got) == len(want) and {(key, x): v for key, x, v in got} == want
    assert made[0].count() == 5 * 33  # the crowd's ball and those of the other four
