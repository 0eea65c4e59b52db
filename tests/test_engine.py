"""Spectra, beams, statistics, files and the facade against NumPy and closed forms."""

import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions import cosmology, physics
from skyweave.operators import beam, filters, grid, selection, spectra, stats
from skyweave.plans.facade import Simulation
from skyweave.sources import fixtures, products, snapshots, suites
from skyweave.streaming import gridding

from .conftest import DATA

N, BOX = 8, 20.0


@pytest.fixture(scope="module")
def cubes(spark):
    """Two sparse grids, as arrays and as tables."""
    r, out = np.random.default_rng(3), []
    for _ in range(2):
        a = r.normal(size=(N, N, N)) * (r.random((N, N, N)) < 0.4)
        rows = [(*map(int, at), float(a[tuple(at)])) for at in np.argwhere(a)]
        out.append((a, spark.createDataFrame(rows, "i int, j int, k int, value double").repartition(5)))
    return out


def dense(df, n=N, names=("value",), d=3):
    out = [np.zeros((n,) * d) for _ in names]
    for r in df.collect():
        for a, x in zip(out, names, strict=True):
            a[tuple(r["ijk"[i]] for i in range(d))] = r[x]
    return out


def waves():
    f = 2 * np.pi * np.fft.fftfreq(N, BOX / N)
    f[N // 2] = -np.pi * N / BOX
    return np.meshgrid(f, f, f, indexing="ij")


@pytest.mark.parametrize("cells", [1 << 18, 100, 20])
def test_fft(cubes, monkeypatch, cells):
    monkeypatch.setattr(spectra, "GROUP_CELLS", cells)
    a, table = cubes[0]
    re, im = dense(spectra.fft(table, N), names=("re", "im"))
    assert np.allclose(re + 1j * im, np.fft.fftn(a))
    back = spectra.fft(spectra.fft(table, N), N, inverse=True)
    assert np.allclose(dense(back, names=("re",))[0], a)
    flat = table.groupBy("i", "j").agg(F.sum("value").alias("value"))
    re, im = dense(spectra.fft(flat, N, ("i", "j")), names=("re", "im"), d=2)
    assert np.allclose(re + 1j * im, np.fft.fft2(a.sum(axis=2)))


def power(a, b, mas):
    kx, ky, kz = waves()
    k = np.sqrt(kx**2 + ky**2 + kz**2)
    p = (np.fft.fftn(a) * np.conj(np.fft.fftn(b))).real * BOX**3 / N**6
    if mas:
        w = np.prod([np.sinc(x * BOX / N / 2 / np.pi) ** 3 for x in (kx, ky, kz)], axis=0)
        p = p / w**2
    keep = (k > 0) & (k <= np.pi * N / BOX)
    number = np.rint(k / (2 * np.pi / BOX)).astype(int)
    return {int(b_): (k[keep & (number == b_)].mean(), p[keep & (number == b_)].mean(), (keep & (number == b_)).sum()) for b_ in np.unique(number[keep])}


@pytest.mark.parametrize("mas", [True, False])
def test_power_and_its_ratios(cubes, mas):
    (a, ta), (b, tb) = cubes
    ma, mb = spectra.fft(ta, N), spectra.fft(tb, N)
    for one, two, x, y in ((ma, None, a, a), (ma, mb, a, b)):
        got = {r["bin"]: (r["k"], r["p"], r["n_modes"]) for r in spectra.power(one, two, N, BOX, mas=mas).collect()}
        want = power(x, y, mas)
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
    pa, pb, px = power(a, a, mas), power(b, b, mas), power(a, b, mas)
    s = {r["bin"]: r["suppression"] for r in spectra.suppression(spectra.power(ma, None, N, BOX, mas=mas), spectra.power(mb, None, N, BOX, mas=mas)).collect()}
    c = {r["bin"]: r["r"] for r in spectra.cross_correlation(*(spectra.power(u, v, N, BOX, mas=mas) for u, v in ((ma, mb), (ma, None), (mb, None)))).collect()}
    assert all(np.isclose(s[i], pa[i][1] / pb[i][1]) and np.isclose(c[i], px[i][1] / math.sqrt(pa[i][1] * pb[i][1])) for i in pa)


def test_power_in_own_bins(cubes):
    a, table = cubes[0]
    edges = [0.3, 0.6, 0.9, 1.3]
    k = np.sqrt(sum(x**2 for x in waves()))
    p = np.abs(np.fft.fftn(a)) ** 2 * BOX**3 / N**6
    got = {r["bin"]: r["p"] for r in spectra.power(spectra.fft(table, N), None, N, BOX, edges, mas=False).collect()}
    assert len(got) == 3 and all(np.isclose(got[i], p[(k >= edges[i]) & (k < edges[i + 1])].mean()) for i in got)


def test_correlation(cubes):
    a, table = cubes[0]
    xi = np.fft.ifftn(np.abs(np.fft.fftn(a)) ** 2).real / N**3
    d = np.array([i if 2 * i < N else i - N for i in range(N)])
    r = np.sqrt(sum(x**2 for x in np.meshgrid(d, d, d, indexing="ij")))
    got = {x["bin"]: (x["r"], x["xi"]) for x in spectra.correlation(spectra.fft(table, N), None, N, BOX).collect()}
    shell = np.rint(r).astype(int)
    assert all(np.allclose(got[i], (r[shell == i].mean() * BOX / N, xi[shell == i].mean())) for i in np.unique(shell))


def test_bias_fields(cubes):
    a, table = cubes[0]
    k = waves()
    q = sum(x**2 for x in k)
    modes = np.fft.fftn(a) * np.exp(-q / (2 * 0.8**2))
    delta = np.fft.ifftn(modes).real
    s2 = 0
    for x in range(3):
        for y in range(3):
            with np.errstate(invalid="ignore", divide="ignore"):
                f = np.where(q > 0, k[x] * k[y] / q - (x == y) / 3, 0)
            s2 = s2 + np.fft.ifftn(modes * f).real ** 2
    want = {"delta": delta - delta.mean(), "delta2": delta**2 - (delta**2).mean(), "s2": s2 - s2.mean(), "nabla2": np.fft.ifftn(-q * modes).real}
    got = spectra.bias_fields(spectra.gaussian_filter(spectra.fft(table, N), N, BOX, 0.8), N, BOX)
    for x, b in zip(want, dense(got, names=tuple(want)), strict=True):
        assert np.allclose(b, want[x]), x


def test_beams(cubes):
    a, table = cubes[0]
    flat = table.groupBy("i", "j").agg(F.sum("value").alias("value"))
    kernel = beam.fourier_kernel(N, 5.0, 2.5)
    direct = [sum(math.cos(2 * math.pi * m * d / N) * math.exp(-0.5 * 25 * (2 * math.pi * min(m, N - m) / N / 2.5) ** 2 / (8 * math.log(2))) for m in range(N)) / N for d in range(N)]
    assert np.allclose(kernel, direct)
    fx, fy = np.meshgrid(*[2 * np.pi * np.fft.fftfreq(N, 2.5)] * 2, indexing="ij")
    want = np.fft.ifft2(np.fft.fft2(a.sum(axis=2)) * beam.gauss_beam(fx**2 + fy**2, 5.0)).real
    assert np.allclose(dense(beam.beamed_map(flat, N, 5.0, 2.5), d=2)[0], want)
    assert beam.beamed_map(flat, N, 0, 2.5) is flat and beam.beamed_map(flat, N, None, 2.5) is flat
    g = beam.gaussian_kernel(32, 6.0, 2.0)
    assert np.isclose(g.sum(), 1) and np.isclose(g[1] / g[0], math.exp(-0.5 / (6 / 2.355 / 2) ** 2)) and g[7] == 0


def test_significance():
    cov = np.array([[4.0, 0], [0, 9.0]])
    assert np.isclose(stats.detection_snr([2, 3], cov), math.sqrt(2)) and np.isclose(stats.detection_snr([3, 4], cov, 1.0), math.sqrt(2))
    assert stats.null_test([2, 3], cov)["dof"] == 2 and np.isclose(stats.null_test([2, 3], cov)["pte"], math.exp(-1))
    assert np.isclose(stats.chi2_tail(3.841459, 1), 0.05, atol=1e-6) and np.isclose(stats.chi2_tail(7.814728, 3), 0.05, atol=1e-6) and np.isclose(stats.chi2_tail(9.487729, 4), 0.05, atol=1e-6)
    assert stats.hartlap_factor(100, 5) == 93 / 99
    with pytest.raises(ValueError):
        stats.hartlap_factor(7, 5)


def test_compensation_with_the_factors_scatter(spark):
    f, r = np.array([0.8, 0.5]), np.array([2.0, 3.0])
    cov, fc = np.array([[1.0, 0.2], [0.2, 2.0]]), np.array([[0.01, 0.004], [0.004, 0.02]])
    table = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(2) for j in range(2)], "i int, j int, cov double")
    factor = spark.createDataFrame([(i, float(x)) for i, x in enumerate(f)], "radius int, factor double")
    ratio = spark.createDataFrame([(i, float(x)) for i, x in enumerate(r)], "radius int, ratio double")
    jac = r / f**2
    got = {(x["i"], x["j"]): x["cov"] for x in stats.compensate(table(cov), factor, ratio, table(fc)).collect()}
    want = cov / np.outer(f, f) + np.outer(jac, jac) * fc
    assert all(np.isclose(got[i, j], want[i, j]) for i in range(2) for j in range(2))
    assert sorted(x["value"] for x in stats.compensated(ratio.withColumnRenamed("ratio", "value"), factor).collect()) == [2.5, 6.0]


def test_selection_over_ranges(spark):
    r = random.Random(5)
    rows = [(i, float(r.choice((1, 2, 5, 7))) * 1e13) for i in range(500)] + [(1000, None)]
    table = spark.createDataFrame(rows, "subhalo_id long, subhalo_mstar double").repartition(7)
    order = [i for i, m in sorted((x for x in rows if x[1]), key=lambda x: (-x[1], x[0]))]
    for count in (0, 1, 33, 499, 500, 900):
        got = {x["subhalo_id"] for x in selection.abundance(table, 1e3, float(count)).collect()}
        assert got == set(order[:count])
    with pytest.warns(DeprecationWarning):
        selection.select(table.withColumnRenamed("subhalo_mstar", "group_mass"), None)


def test_cosmology_and_units():
    flat = cosmology.Flat(0.7, 0.3, 0.05)
    z = np.linspace(0, 0.5, 200_001)
    e = 1 / np.sqrt(0.3 * (1 + z) ** 3 + 0.7)
    mpc = 299792.458 / 70 * np.sum((e[1:] + e[:-1]) / 2) * (z[1] - z[0])
    assert np.isclose(flat.comoving_mpc(0.5), mpc, rtol=1e-3)  # radiation is a thousandth at most
    arcmin = cosmology.comoving_to_arcmin(1e5, 0.5, flat)
    assert np.isclose(arcmin, math.degrees(1e5 / 0.7 / 1000 / mpc) * 60, rtol=1e-3) and np.isclose(cosmology.arcmin_to_comoving(arcmin, 0.5, flat), 1e5)
    n, pixel = cosmology.map_pixels(1e5, 0.5, 0.5, flat)
    assert n == math.ceil(arcmin / 0.5) and np.isclose(n * pixel, arcmin)
    assert cosmology.pixel_length("kpc/h", 1e5, 100, 0.5, flat) == 1000 and np.isclose(cosmology.pixel_length("arcmin", 1e5, 100, 0.5, flat), arcmin / 100)
    with pytest.raises(ValueError):
        cosmology.pixel_length("deg", 1e5, 100, 0.5, flat)
    assert np.isclose(physics.comparative_factor("gas", "total", 0.05, 0.3), 6) and np.isclose(physics.comparative_factor("DM", "total", 0.05, 0.3), 0.05 / 0.25 * 6) and physics.comparative_factor("DM", "Stars", 0.05, 0.3) == 1


def test_suite_rules(spark):
    halos = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0, 6.0, True), (2, 2.0, 3.0, 4.0, 5.0, 6.0, False)], "group_id long, pos_x double, pos_y double, pos_z double, group_mass double, group_rad double, is_central boolean")
    a, b, c = (f.where("group_id = 1").head() for f in (suites.halos_a(halos), suites.halos_b(halos, 0.5), suites.halos_c(halos, 0.5)))
    assert (a["pos_x"], a["group_mass"]) == (2, 5e10) and (b["pos_x"], b["group_mass"], b["group_rad"]) == (1, 2.5, 3)
    assert (c["pos_x"], c["group_mass"], c["group_rad"]) == (1000, 2.5e10, 3000) and suites.halos_c(halos, 0.5).count() == 1
    sub = spark.createDataFrame([(1, 7, 2.0, 2.0, 2.0, 3.0, 4.0, 5.0)], "subhalo_id long, parent_halo_index long, pos_x double, pos_y double, pos_z double, subhalo_mstar double, dm_30kpc double, total_mass double")
    got = suites.subhalos_b(sub, 0.5).head()
    assert (got["parent_group_id"], got["pos_x"], got["subhalo_mass"], got["subhalo_mstar"]) == (7, 1, 4.5, 1.5)
    p = spark.createDataFrame([(1.0, 4.0, 2.0, 3.0, 0.5, 6.0, 1.0, -1.0, 2.0)], "mass double, densities double, electron_number_density double, compton_y double, x double, y double, vx double, vy double, vz double")
    sz = p.select(*[v.alias(n) for n, v in physics.sz_from_catalogue(0.5, 0.8, 10.0).items()]).head()
    assert np.isclose(sz["kSZ_y"] / sz["kSZ_z"], -0.5) and np.isclose(sz["kSZ_x"] / sz["tau"], 1 / 29979245800.0, rtol=1e-9, atol=0)
    with pytest.raises(ValueError):
        snapshots.location("r", "D", 1)
    with pytest.raises(ValueError):
        snapshots.location("r", "B", 1)
    with pytest.warns(UserWarning):
        assert suites.check_redshift(0.5, 0.6) == 0.5
    assert suites.data_root("here") == "here/" and suites.data_root(None, "NO_SUCH_VARIABLE") == "data/"


def test_scans_read_what_they_need(spark, tmp_path):
    fixtures.particles(spark, DATA).write.parquet(f"{tmp_path}/p")
    rows = suites.scan(spark, f"{tmp_path}/p", "tau", ["x", "mass"])
    gas = fixtures.particles(spark, DATA).where("ptype = 'gas'")
    assert rows.columns == ["x", "mass"] and rows.count() == gas.count() and np.isclose(rows.agg(F.sum("mass")).head()[0], gas.agg(F.sum("mass")).head()[0])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ptype,gas)" in plan and "ReadSchema: struct<ptype:string,x:double,mass:double>" in plan


def test_temperature_of_a_mass(spark):
    """T_CMB v / c sigma_T / (mu_e m_p), for a mass of so many kg/m^2."""
    got = spark.range(1).select(physics.mass_to_temperature(F.lit(3.0), 250.0, 1.2).alias("t")).head()["t"]
    assert np.isclose(got, 3.0 * 2.7255 * 250e3 / 299792458.0 * 6.6524587321e-29 / (1.2 * 1.67262192369e-27), rtol=1e-9)


def test_snapshots_and_headers(spark, tmp_path):
    assert snapshots.location("r", "A", 67) == "r/snapdir_067/snap_067.0.hdf5" and snapshots.location("r/", "A", 67, folder=True) == "r/snapdir_067/"
    assert snapshots.location("r", "B", 151, "m100") == "r/snapshots/snap_m100_151.hdf5" == snapshots.location("r", "B", 151, "m100", folder=True)
    assert snapshots.location("r", "C", 67) == "r/snapshots/flamingo_0067/flamingo_0067.hdf5"
    for bad in (("D", None), ("B", None)):
        with pytest.raises(ValueError):
            snapshots.location("r", bad[0], 1, bad[1])
    attributes = spark.createDataFrame([(1000.0, 0.681, 0.306, 0.0486, 0.5, [7, 8], [1, 2])], "box double, h double, omega_m double, omega_b double, redshift double, n_total array<long>, n_this_file array<long>")
    h = snapshots.header_of(attributes, "C")
    assert np.isclose(h.box, 681_000) and np.isclose(h.a, 1 / 1.5) and snapshots.header_of(attributes, "A").box == 1000
    assert {r["ptype"]: r["n"] for r in snapshots.particle_counts(attributes, "C").collect()} == {0: 1, 1: 2}
    assert {r["ptype"]: r["n"] for r in snapshots.particle_counts(attributes, "A").collect()} == {0: 7, 1: 8}
    with pytest.raises(ValueError):
        snapshots.header_of(attributes.where("false"), "A")
    parts = [np.arange(6.0).reshape(2, 3) + 10 * i for i in range(3)]
    for i, a in enumerate(parts):
        np.save(tmp_path / f"position_part{i + 1}_of_3.npy", a)
    got = [(r["x"], r["y"], r["z"]) for r in snapshots.array_parts(spark, f"{tmp_path}/*.npy", ("x", "y", "z")).orderBy("part", "idx").collect()]
    assert np.array_equal(got, np.concatenate(parts)) and snapshots.archive_snapshot(0.5) == 214
    with pytest.raises(ValueError):
        snapshots.archive_snapshot(0.7)


def test_products_and_results(spark, tmp_path):
    base = str(tmp_path)
    g = spark.createDataFrame([(0, 1, 2.5)], "i int, j int, value double")
    one, two = products.Product("A", "s", 1, "gas", 8), products.Product("A", "s", 1, "gas", 8, beam=1.6)
    assert one.path(base) != two.path(base)
    with pytest.raises(ValueError):
        products.load(spark, one, base)
    calls = []
    make = lambda: calls.append(1) or g
    for _ in range(2):
        assert products.load_or_make(spark, one, base, make, keep=True).head()["value"] == 2.5
    assert len(calls) == 1
    with pytest.raises(ValueError):
        products.Product("A", "s", 1, "gas", 8, kind="map", dim="3D").path(base)
    products.save_measurements({"bin": {"m": np.eye(2)}}, f"{base}/m.npz")
    m = products.measurements(spark, f"{base}/m.npz")
    tree = products.nested(m.select(F.concat_ws("/", "outer", "inner").alias("path"), "idx", "value"))
    assert tree["bin"]["m"].tolist() == [1, 0, 0, 1]
    with pytest.raises(TypeError):
        products.save_measurements({"bin": 1}, f"{base}/n.npz")
    (tmp_path / "m.csv").write_text("r,v,v_err\n1,2,0.5\n")
    assert tuple(products.measurement_csv(spark, f"{base}/m.csv", "r", "v").head()) == (1.0, 2.0, 0.5)
    assert products.number("1e13") == 1e13 and products.number("x") == "x"
    sims = products.simulations(spark, {"simulations": [{"sim_type": "B", "sims": [{"name": "m", "snapshot": "151", "feedback": "s50"}]}]})
    assert tuple(sims.head()) == ("B", "m", 151, "s50", None)
    with pytest.raises(FileNotFoundError):
        products.load_spectra(spark, base, "B", "m", 151, 8, "s50")
    products.save_spectra(g, base, "B", "m", 151, 8, "s50")
    assert products.load_spectra(spark, base, "B", "m", 151, 8, "s50").count() == 1
    rows = spark.createDataFrame([("A", "t", None, 1.0, 2.0, 3.0), ("B", "m", "s50", 1.0, 5.0, 3.0), ("B", "m", "m", 1.0, 7.0, 3.0)], "suite string, sim string, feedback string, x double, mean double, err double")
    products.save_profiles(rows, f"{base}/profiles")
    assert [products.load_profiles(spark, f"{base}/profiles", *k).head()["mean"] for k in (("A", "t"), ("B", "m", "s50"), ("B", "m", "m"))] == [2, 5, 7]
    products.save_scalars(spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, value double"), f"{base}/scalars")
    assert products.load_scalars(spark, f"{base}/scalars") == {"a": 1.5, "b": 2.0}
    assert spark.range(1).select(physics.label(F.lit("a_b")), physics.label(F.lit("a_b"), tex=False)).head()[:] == (r"a\_b", "a-b")


@pytest.fixture(scope="module")
def simulation(spark):
    return Simulation(fixtures.particles(spark, DATA), fixtures.halos(spark, DATA), fixtures.subhalos(spark, DATA), fixtures.HEADER)


def test_fields_and_maps_of_a_simulation(spark, simulation, tmp_path):
    s = Simulation(**{**simulation.__dict__, "base": str(tmp_path), "grids": {}})
    plain = grid.field(s.particles, "gas", s.header, 16)
    total = lambda f: f.agg(F.sum("value")).head()[0]
    first = s.make_field("gas", 16, save=True)
    assert np.isclose(total(first), total(plain)) and np.isclose(total(products.load(spark, s._product("gas", 16, "xy", None), s.base)), total(plain))
    assert 0 < total(s.make_field("gas", 16, mask_radius=3.0, load=False)) < total(plain)
    n, _ = s.map_pixels(pixel=8.0)
    smooth, bare = s.make_map("tau", pixel=8.0, beam_arcmin=12.0, load=False), s.make_map("tau", pixel=8.0, beam_arcmin=0.0, load=False)
    assert np.isclose(total(smooth), total(bare)) and smooth.count() == n * n > bare.count()
    own = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, value double")
    s.set_field("gas", own, 16)
    s.set_map("tau", own, pixel=8.0, beam_arcmin=12.0)
    assert s.make_field("gas", 16) is own and s.make_map("tau", pixel=8.0, beam_arcmin=12.0) is own and s.make_map("tau", pixel=8.0, beam_arcmin=None) is not own
    assert s.subset("baryon", ["mass"]).columns == ["mass"] and s.at(1.0).header.z == 1.0 and not s.at(1.0).grids


def test_stacks_of_a_simulation(spark, simulation):
    """Of a map of ones an aperture's sum is its count of pixels, and a compensated filter gives nothing."""
    s = Simulation(**{**simulation.__dict__, "grids": {}})
    n, pixel = s.map_pixels(pixel=8.0)
    ones = spark.range(n * n).selectExpr(f"cast(id div {n} as int) i", f"cast(id % {n} as int) j", "1.0D value")
    s.set_map("tSZ", ones, pixel=8.0, beam_arcmin=None)
    chosen = s.halos.where("group_id < 6").select("group_id")
    half = round(21 / pixel)  # a square of 21 arcmin each way, in whole pixels
    inside = sum(math.hypot(x, y) * 21 / half < 20.0 for x in range(-half, half + 1) for y in range(-half, half + 1))
    got = s.stack_map("tSZ", "cumulative", [20.0], pixel=8.0, beam_arcmin=None, chosen=chosen).collect()
    assert {(r["group_id"], round(r["value"], 6)) for r in got} == {(i, inside * 64.0) for i in range(6)}
    flat = s.stack_map("tSZ", "cumulative", [20.0], pixel=8.0, beam_arcmin=None, subtract_mean=True, chosen=chosen).collect()
    assert all(abs(r["value"]) < 1e-9 for r in flat)
    s.set_field("gas", ones, n)
    per = s.header.box / n
    got = s.stack_field("gas", "cumulative", [20.0 / pixel], distance=per, n=n, chosen=chosen).collect()
    assert all(r["value"] == sum(math.hypot(x, y) * pixel < 20.0 for x in range(-3, 4) for y in range(-3, 4)) for r in got)
    with pytest.raises(ValueError):
        s.stack(ones, n, "CAP", [1.0], "deg")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        rows, key = s.select(mean_mass=None)
    assert key == "group_id" and any(w.category is DeprecationWarning for w in seen) and rows.count() == selection.binned(s.halos, 2).count()
    assert s.select(use_subhalos=True, upper=None)[1] == "subhalo_id"


def test_gridding_of_a_stream(spark, simulation, tmp_path):
    rows = simulation.particles.where("ptype = 'gas'").select("x", "y", "mass")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    q = gridding.start(spark, f"{tmp_path}/in", rows.schema, simulation.header.box, 8, "gridded", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    want = {(r["i"], r["j"]): r["value"] for r in grid.field(rows.withColumn("ptype", F.lit("gas")), "gas", simulation.header, 8, unit=1.0).collect()}
    got = {(r["i"], r["j"]): r["value"] for r in spark.table("gridded").collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_profiles_from_a_mass_curve():
    radii = np.linspace(0.1, 8, 80)
    mass, r = radii**3, np.linspace(0.5, 4, 8)
    assert np.allclose(filters.cap_from_mass(r, radii, mass), (2 - 2**1.5) * r**3, rtol=1e-3)
    assert np.allclose(filters.delta_sigma_from_mass(r, radii, mass), r / np.pi - 3 * r / (2 * np.pi), rtol=1e-2)
