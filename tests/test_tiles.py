"""Tiled grids against NumPy, and stacks by maps against stacks by offsets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import beam, filters, spectra, stack, tiles

BOX = 20.0


def table(spark, a):
    rows = [(*map(int, at), float(a[tuple(at)])) for at in np.argwhere(a)]
    names = "ijk"[: a.ndim]
    return spark.createDataFrame(rows, ", ".join(f"{x} int" for x in names) + ", value double").repartition(3)


def array(t, name="value"):
    out = np.full([t.shape[t.axes.index(x)] for x in "ijk" if x in t.axes], np.nan, complex if t.dtype == "<c16" else float)
    for r in tiles.cells(t, name).collect():
        out[tuple(r[x] for x in "ijk" if x in t.axes)] = complex(r["re"], r["im"]) if t.dtype == "<c16" else r[name]
    return out


def sparse(seed, shape, share=0.4):
    r = np.random.default_rng(seed)
    return r.normal(size=shape) * (r.random(shape) < share)


SIZES = [(40, 1 << 17), (12, 1)]  # cells of a tile, and of a plane that is transformed at once


@pytest.fixture(params=SIZES)
def small(request, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_CELLS", request.param[0])
    monkeypatch.setattr(tiles, "PLANE_CELLS", request.param[1])
    return request.param


@pytest.mark.parametrize("shape", [(4, 5, 6), (7, 9)])
def test_transform_and_back(spark, small, shape):
    a = sparse(1, shape)
    t = tiles.filled(table(spark, a), shape)
    assert np.array_equal(array(t), a)
    f = tiles.transform(t)
    assert np.allclose(array(f), np.fft.rfftn(a))
    assert np.allclose(array(tiles.inverse(f)), a)
    for axis in "ik"[: len(shape) - 1]:
        assert np.allclose(array(tiles.projected(t, axis)), a.sum(axis="ijk".index(axis)))


@pytest.mark.parametrize("n,mas", [(8, True), (9, False)])
def test_half_spectra_have_the_same_power(spark, n, mas):
    a, b = sparse(2, (n,) * 3), sparse(3, (n,) * 3)
    one, two = (tiles.transform(tiles.filled(table(spark, x), x.shape)) for x in (a, b))
    full = [spectra.fft(table(spark, x), n) for x in (a, b)]
    for half, whole in (((one, None), (full[0], None)), ((one, two), full)):
        for edges in (None,) if half[1] is None else ([0.3, 0.6, 0.9, 1.3],):
            got = {r["bin"]: r[:] for r in tiles.power(*half, BOX, edges, mas).select("bin", "k", "p", "n_modes").collect()}
            want = {r["bin"]: r[:] for r in spectra.power(*whole, n, BOX, edges, mas).select("bin", "k", "p", "n_modes").collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_means_and_filters(spark):
    a = sparse(4, (10, 10)) ** 2
    t = tiles.filled(table(spark, a), a.shape)
    assert np.isclose(tiles.total(t).head()[0], a.sum())
    assert np.allclose(array(tiles.subtract_mean(t)), a - a.mean()) and np.allclose(array(tiles.overdensity(t)), a / a.mean() - 1)
    assert np.isnan(array(tiles.overdensity(tiles.filled(table(spark, a).where("false"), a.shape)))).all()
    assert np.allclose(array(tiles.paired(t, t, lambda _, __, x, y: x * y)), a * a)
    k = np.sqrt(sum(x**2 for x in np.meshgrid(*[2 * np.pi * np.fft.fftfreq(10, BOX / 10)] * 2, indexing="ij")))
    got = tiles.inverse(tiles.filtered(tiles.transform(t), lambda k: np.exp(-sum(x**2 for x in k.values())), BOX))
    assert np.allclose(array(got), np.fft.ifft2(np.fft.fft2(a) * np.exp(-(k**2))).real)
    kernel = beam.fourier_kernel(10, 5.0, 2.5)
    want = np.zeros((10, 10))
    for r in beam.convolve(table(spark, a), kernel).collect():
        want[r["i"], r["j"]] = r["value"]
    assert np.allclose(array(tiles.smoothed(t, kernel)), want)
    with pytest.raises(ValueError):
        tiles.smoothed(t, kernel[:5])


def test_shuffled_bytes_of_a_cell(spark):
    """Pieces carry eight or sixteen bytes a cell and little else."""
    n = 128
    t = tiles.layout((n, n, n))
    a = np.zeros((4, 8, n))
    out = tiles.layout((n, n, n), "kij")
    pieces = list(tiles._cut(out, [0, 0, 0], a.transpose(2, 0, 1)))
    held = sum(len(p[3]) for p in pieces)
    around = len(pieces) * (8 + 2 * 3 * 8)
    assert t.sides[0] == t.sides[1] and held == a.size * 8 and around < held / 4


# ---------------------------------------------------------------- stacks


def plain(a, at, name, radii, per_unit, **more):
    """Profiles of objects by loops over their cutouts."""
    n, g = len(a), filters.Geometry.of(name, np.array(radii), per_unit)
    d = np.arange(-g.half, g.half + 1)
    rr = np.hypot(*np.meshgrid(d, d, indexing="ij")).ravel() * g.step
    out = {}
    for key, (x, y) in at.items():
        cut = a[np.ix_((x + d) % n, (y + d) % n)].ravel()
        if name == "DSigma_mccarthy":
            order = np.argsort(rr, kind="stable")
            s = cut[order] / more["pixel"] ** 2
            excess = np.cumsum(s) / np.arange(1, len(s) + 1) - s
            which = np.digitize(rr[order], more["edges"]) - 1
            for b, r in enumerate(radii):
                out[key, r] = excess[which == b].mean() if (which == b).any() else None
        else:
            for r in radii:
                inner, outer = rr < r, (rr >= r) & (rr < r + more["dr"])
                out[key, r] = (cut[inner].mean() - (cut[outer].mean() if outer.any() else 0)) / more["pixel"] ** 2
    return out


@pytest.mark.parametrize("n", [7])
def test_both_ways_of_a_stack(spark, n):
    """Also where the square of offsets goes round the box more than once."""
    a = np.abs(sparse(5, (n, n), 0.7))
    objects = spark.createDataFrame([(i, (i * 37 % 50) / 50 * BOX, (i * 11 % 50) / 50 * BOX, 0.0) for i in range(30)] + [(77, BOX, BOX, 0.0)], "group_id long, pos_x double, pos_y double, pos_z double")
    at = {r["group_id"]: tuple(int(np.rint(r[x] / (BOX / n))) for x in ("pos_x", "pos_y")) for r in objects.collect()}
    radii, per = [1.0, 2.2, 3.1], 1.4
    unit = per * BOX / n
    two = table(spark, a).withColumn("other", F.col("value") * 2)
    for name, more in (("DSigma", {"pixel": 2.5, "dr": 0.75}), ("DSigma_mccarthy", {"pixel": 1.5, "edges": (0.2, 1.1, 2.0, 3.6)}), ("DSigma_mccarthy", {"pixel": 1.5, "edges": (0.2, 0.21, 2.0, 3.6)})):
        want = plain(a, at, name, radii, per, **more)
        for way in ("offsets", "maps"):
            got = {(r["group_id"], r["radius"]): (r["value"], r["other"]) for r in stack.profiles(two, objects, n, BOX, name, radii, unit, way=way, values=("value", "other"), **more).collect()}
            assert got.keys() == want.keys()
            assert all((got[k] == (None, None)) if want[k] is None else np.allclose(got[k], (want[k], 2 * want[k])) for k in want)
    for name in ("CAP", "upsilon", lambda r, at: np.exp(-r / at)):
        one, other = ({(r["group_id"], r["radius"]): r["value"] for r in stack.profiles(two, objects, n, BOX, name, radii, unit, way=way, dr=0.8).collect()} for way in ("offsets", "maps"))
        assert one.keys() == other.keys() and all(math.isclose(one[k], other[k], rel_tol=1e-9, abs_tol=1e-9) for k in one)


def test_the_way_is_chosen_by_counts(spark, monkeypatch):
    a = np.abs(sparse(6, (16, 16), 0.5))
    objects = spark.range(40).selectExpr("id AS group_id", "double(id % 20) AS pos_x", "double(id % 7) AS pos_y", "0.0D AS pos_z")
    kernels = filters.Kernels.of("cumulative", [2.0], 1.0)
    assert stack._cheaper(objects, kernels, 16) == "offsets" and stack._cheaper(objects.crossJoin(spark.range(40)), kernels, 16) == "maps"
    monkeypatch.setattr(stack, "PIXELS", 10)
    assert stack._cheaper(objects, kernels, 16) == "maps"
    got = stack.profiles(table(spark, a), objects, 16, BOX, "cumulative", [2.0], 1.25)
    plan = got._jdf.queryExecution().toString()
    assert "di" not in plan.split("Physical")[-1].replace("radius", "")  # no offsets
    assert got.count() == 40
