"""Many simulations at once, 3D fields and the suppression driver, files along a curve, and a stored field that grows."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyweave.operators import filters, grid, many, selection, spectra, stats
from skyweave.plans.facade import Simulation
from skyweave.sources import cells, fixtures, products
from skyweave.streaming import gridding

from .conftest import DATA


@pytest.fixture(scope="module")
def simulation(spark):
    return Simulation(fixtures.particles(spark, DATA), fixtures.halos(spark, DATA), fixtures.subhalos(spark, DATA), fixtures.HEADER)


def values(df, *names):
    return {tuple(r[x] for x in names): r["value"] for r in df.collect()}


@pytest.mark.parametrize("ptype", ["total", "kSZ"])
def test_fields_of_many_boxes_are_those_of_each(spark, simulation, ptype):
    headers = {"a": fixtures.Header(102400.0, 0.6774, z=0.5, n=16), "b": fixtures.Header(60000.0, 0.7, z=1.0, n=9)}
    table = many.headers(spark, [(x, h.box, h.n, h.h, h.z) for x, h in headers.items()])
    rows = simulation.particles.withColumn("sim", F.lit("a")).unionByName(simulation.particles.withColumn("sim", F.lit("b"))).unionByName(simulation.particles.withColumn("sim", F.lit("unknown")))
    got = values(many.fields(rows, table, ptype), "sim", "i", "j")
    want = {(x, *k): v for x, h in headers.items() for k, v in values(grid.field(simulation.particles, ptype, h), "i", "j").items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-300) for k in want)


def test_too_many_simulations(spark, simulation, monkeypatch):
    monkeypatch.setattr(many, "SIMULATIONS", 1)
    with pytest.raises(ValueError, match="more than 1"):
        many.fields(simulation.particles.withColumn("sim", F.lit("a")), many.headers(spark, [("a", 1.0, 1, 1.0, 0.0), ("b", 1.0, 1, 1.0, 0.0)]), "gas")


# ---------------------------------------------------------------- 3D fields and spectra


def test_three_dimensional_fields(spark, simulation, tmp_path):
    s = Simulation(**{**simulation.__dict__, "base": str(tmp_path), "grids": {}})
    plain = values(grid.tsc_grid(grid.of_type(s.particles, "gas"), F.col("mass") * 1e10, s.header.box, 8), "i", "j", "k")
    first = values(s.make_field("gas", 8, dim="3D", save=True), "i", "j", "k")
    assert first.keys() == plain.keys() and all(math.isclose(first[k], plain[k], rel_tol=1e-12) for k in plain)
    held = products.load(spark, products.Product("A", "sim", 0, "gas", 8, "xyz", dim="3D"), s.base)
    assert values(held, "i", "j", "k") == first
    total = s.make_field("total", 8, dim="3D", save=True)
    assert math.isclose(total.agg(F.sum("value")).head()[0], grid.of_type(s.particles, "total").agg(F.sum("mass")).head()[0] * 1e10, rel_tol=1e-9)
    for part in grid.COMPONENTS["total"]:  # the components were kept as well
        products.load(spark, products.Product("A", "sim", 0, part, 8, "xyz", dim="3D"), s.base)
    in_balls = s.make_field("gas", 16, mask_radius=3.0, load=False, dim="3D")
    flat = s.make_field("gas", 16, mask_radius=3.0, load=False)
    assert math.isclose(in_balls.agg(F.sum("value")).head()[0], flat.agg(F.sum("value")).head()[0])
    assert s.make_field("tSZ", 8, load=False, dim="3D").agg(F.sum("value")).head()[0] > 0
    with pytest.raises(ValueError, match="2D or 3D"):
        s.make_field("gas", 8, dim="4D")


def test_suppression_with_its_cache(spark, simulation, tmp_path):
    s = Simulation(**{**simulation.__dict__, "base": str(tmp_path), "grids": {}})
    n, box = 8, s.header.box / 1e3
    got = s.suppression(n, save=True)
    modes = {}
    for t in ("DM", "total"):
        g = grid.tsc_grid(grid.of_type(s.particles, t), F.col("mass"), s.header.box, n)
        mean = g.agg((F.sum("value") / n**3).alias("m"))
        modes[t] = spectra.fft(g.crossJoin(mean).select("i", "j", "k", (F.col("value") / F.col("m")).alias("value")), n).cache()
    power = {c: {r["bin"]: r["p"] for r in spectra.power(*p, n, box).collect()} for c, p in (("p_dm", (modes["DM"], None)), ("p_total", (modes["total"], None)), ("p_cross", (modes["DM"], modes["total"])))}
    rows = got["spectra"].collect()
    assert len(rows) == len(power["p_dm"]) > 0
    for r in rows:
        assert all(math.isclose(r[c], power[c][r["bin"]], rel_tol=1e-9) for c in power)
        assert math.isclose(r["suppression"], r["p_total"] / r["p_dm"]) and math.isclose(r["coherence"], r["p_cross"] / math.sqrt(r["p_dm"] * r["p_total"]))
    xi = got["correlations"].collect()
    assert {"r", "xi_dm", "xi_total", "xi_cross"} <= set(got["correlations"].columns) and len(xi) > 3
    bare = Simulation(simulation.particles.where("false"), s.halos, s.subhalos, s.header, base=s.base)  # nothing but the cache
    assert sorted(map(str, bare.suppression(n, load=True)["spectra"].collect())) == sorted(map(str, rows))
    assert sorted(map(str, bare.suppression(n, load=True)["correlations"].collect())) == sorted(map(str, xi))


def test_opening_a_snapshot(spark, simulation, tmp_path):
    spark.createDataFrame([(102.4, 0.5, 0.3, 0.05, 0.5)], "box double, h double, omega_m double, omega_b double, redshift double").write.parquet(f"{tmp_path}/header")
    simulation.particles.write.parquet(f"{tmp_path}/particles")
    simulation.halos.withColumn("is_central", F.col("group_id") % 2 == 0).write.parquet(f"{tmp_path}/halos")
    simulation.subhalos.write.parquet(f"{tmp_path}/subhalos")
    s = Simulation.open(spark, str(tmp_path), "C", n=8)
    assert (s.header.box, s.header.h, s.header.n) == (51200.0, 0.5, 8)
    one, own = s.load_halos().orderBy("group_id").first(), simulation.halos.where("group_id % 2 = 0").orderBy("group_id").first()
    assert one["pos_x"] == own["pos_x"] * 500 and one["group_mass"] == own["group_mass"] * 5e9
    assert s.load_subhalos().count() == simulation.subhalos.count()
    gas = s.load_subsets("tSZ", ["x", "mass"])
    assert gas.columns == ["x", "mass"] and math.isclose(gas.agg(F.sum("mass")).head()[0], simulation.subset("gas").agg(F.sum("mass")).head()[0] / 2)
    assert s.load_subset("gas", f"{tmp_path}/particles", ["mass"]).count() == gas.count()
    with pytest.raises(ValueError, match="unknown suite"):
        Simulation.open(spark, str(tmp_path), "D")


def test_options_of_field_stacks(spark, simulation):
    """Excesses have the unit's own ring and area; radii may be in mean radii; a field's mean goes first."""
    s = Simulation(**{**simulation.__dict__, "grids": {}})
    n = 16
    field = s.make_field("gas", n, load=False)
    chosen = s.halos.where("group_id < 5").select("group_id")
    per = s.header.box / n
    dense = np.zeros((n, n))
    for r in field.collect():
        dense[r["i"], r["j"]] = r["value"]
    at = {r["group_id"]: (round(r["pos_x"] / per), round(r["pos_y"] / per)) for r in s.halos.where("group_id < 5").collect()}

    def plain(a, radii, distance, dr, area):
        per_unit, out = distance / per, {}
        g = filters.Geometry.of("DSigma", np.array(radii), per_unit)
        d = np.arange(-g.half, g.half + 1)
        rr = np.hypot(*np.meshgrid(d, d, indexing="ij")) * g.step
        for key, (x, y) in at.items():
            cut = a[np.ix_((x + d) % n, (y + d) % n)]
            for r in radii:
                out[key, r] = (cut[rr < r].mean() - cut[(rr >= r) & (rr < r + dr)].mean()) / area
        return out

    radii = [1.1, 2.2]
    got = values(s.stack_field("gas", "DSigma", radii, 9000.0, n, load=False, chosen=chosen), "group_id", "radius")
    want = plain(dense, radii, 9000.0, 3 * per / 9000.0, per**2)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    for way in ("offsets", "maps"):
        flat = values(s.stack_field("gas", "cumulative", radii, 9000.0, n, subtract_mean=True, load=False, chosen=chosen, way=way), "group_id", "radius")
        g = filters.Geometry.of("cumulative", np.array(radii), 9000.0 / per)
        d = np.arange(-g.half, g.half + 1)
        rr = np.hypot(*np.meshgrid(d, d, indexing="ij")) * g.step
        assert all(math.isclose(flat[k, r], (dense - dense.mean())[np.ix_((at[k][0] + d) % n, (at[k][1] + d) % n)][rr < r].sum(), rel_tol=1e-6) for k in at for r in radii)
    mean = selection.mean_radius(s.halos).first()[0]
    if mean:
        one, two = (values(s.stack_field("gas", "CAP", [30.0], x, n, load=False, chosen=chosen), "group_id", "radius") for x in (None, mean))
        assert one == two
    arcmin, _ = s.map_pixels(pixel=30.0), None
    m = s.make_map("gas", pixel=30.0, beam_arcmin=None, load=False)
    n = arcmin[0]
    per, dense = s.header.box / n, np.zeros((n, n))
    for r in m.collect():
        dense[r["i"], r["j"]] = r["value"]
    at = {k["group_id"]: (round(k["pos_x"] / per), round(k["pos_y"] / per)) for k in s.halos.where("group_id < 5").collect()}
    got = values(s.stack_map("gas", "DSigma", [40.0], pixel=30.0, beam_arcmin=None, load=False, chosen=chosen), "group_id", "radius")
    g = filters.Geometry.of("DSigma", np.array([40.0]), 1 / arcmin[1])
    d = np.arange(-g.half, g.half + 1)
    rr = np.hypot(*np.meshgrid(d, d, indexing="ij")) * g.step
    for (key, r), v in got.items():
        cut = dense[np.ix_((at[key][0] + d) % n, (at[key][1] + d) % n)]
        ring = (rr >= r) & (rr < r + 0.75)
        assert math.isclose(v, (cut[rr < r].mean() - (cut[ring].mean() if ring.any() else 0)) / arcmin[1] ** 2, rel_tol=1e-9)
    with pytest.raises(ValueError, match="arcmin"):
        s.stack(m, n, "DSigma_mccarthy", [1.0], "kpc/h")


def test_a_run_configuration(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "run.yaml").write_text("stack: {min_mass: 1e13, radii: [0.5, 1]}\nsimulations:\n  - sim_type: B\n    sims:\n      - {name: m100, snapshot: 151, feedback: s50, redshift: 0.5}\n      - {name: m50, snapshot: 7}\n")
    config = products.read_config(spark, f"{tmp_path}/run.yaml")
    assert products.number(config["stack"]["min_mass"]) == 1e13 and config["stack"]["radii"] == [0.5, 1]
    assert [tuple(r) for r in products.simulations(spark, config).orderBy("snapshot").collect()] == [("B", "m50", 7, None, None), ("B", "m100", 151, "s50", 0.5)]
    (tmp_path / "none.yaml").write_text("- 1")
    with pytest.raises(ValueError, match="no configuration"):
        products.read_config(spark, f"{tmp_path}/none.yaml")


# ---------------------------------------------------------------- files along a curve


@pytest.mark.parametrize("n", [1, 5, 8])
def test_ranges_hold_a_region(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        at, r = rng.random(3) * 100, rng.random() * 60
        spans = [cells._spans(x, r, 100.0, n) for x in at]
        want = {cells.code_of((a, b, c)) for a in range(n) for b in range(n) for c in range(n) if all(any(lo <= x <= hi for lo, hi in s) for x, s in zip((a, b, c), spans, strict=True))}
        for most in (64, 3, 1):
            got = cells.ranges(spans, n, most)
            assert len(got) <= most and all(x[1] < y[0] for x, y in zip(got[:-1], got[1:], strict=True))
            assert all(any(lo <= x <= hi for lo, hi in got) for x in want)


def test_files_and_row_groups_are_skipped(spark, tmp_path):
    n, box, centre, radius = 64, 100.0, (97.0, 3.0, 50.0), 9.0
    rows = spark.range(60_000).select("id", *[(F.rand(s) * box).alias(x) for s, x in enumerate("xyz")])
    rows.write.parquet(f"{tmp_path}/plain")
    rows = spark.read.parquet(f"{tmp_path}/plain")
    path = cells.write(rows, f"{tmp_path}/curve", box, n, files=24, group_bytes=8 << 10)
    files = list((tmp_path / "curve").glob("*.parquet"))
    got = cells.read_sphere(spark, path, centre, radius, box, n)
    d = [F.col(x) - c - box * F.rint((F.col(x) - c) / box) for x, c in zip("xyz", centre, strict=True)]
    want = rows.where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < radius**2)
    assert got.columns == rows.columns and {r["id"] for r in got.collect()} == {r["id"] for r in want.collect()}
    assert len(got.inputFiles()) < len(files) / 2
    met = cells.ranges([cells._spans(c, radius, box, n) for c in centre], n)
    read = groups = 0
    for f in got.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        at = meta.schema.names.index(cells.CODE)
        for g in range(meta.num_row_groups):
            stats_ = meta.row_group(g).column(at).statistics
            groups += 1
            read += any(stats_.max >= a and stats_.min <= b for a, b in met)
    assert 0 < read < groups
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Or(" in plan.split("PushedFilters: [")[1]  # the ranges
    assert cells.read_sphere(spark, cells.write(rows.where("false"), f"{tmp_path}/none", box, n), centre, radius, box, n).count() == 0


# ---------------------------------------------------------------- a stored field


def test_a_stored_field_takes_each_batch_once(spark, simulation, tmp_path):
    rows = simulation.particles.where("ptype = 'gas'").select("x", "y", "mass")
    parts = rows.randomSplit([1.0, 1.0, 1.0], 5)
    box, path, source, state = simulation.header.box, f"{tmp_path}/field", f"{tmp_path}/in", f"{tmp_path}/state"
    with pytest.raises(ValueError, match="no field"):
        gridding.current(spark, path)
    for i, p in enumerate(parts):
        p.write.mode("append").parquet(source)
        q = gridding.follow(spark, source, rows.schema, path, box, 8, state)  # starts again each time
        q.processAllAvailable()
        q.stop()
    want = values(grid.field(rows.withColumn("ptype", F.lit("gas")), "gas", simulation.header, 8, unit=1.0), "i", "j")
    same = lambda: (lambda got: got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want))(values(gridding.current(spark, path), "i", "j"))
    assert same()
    last = gridding._versions(spark, path)[-1]
    gridding.merge(spark.read.parquet(source).limit(0).unionByName(parts[2]) if last == 2 else rows.limit(0), last, path, box, 8)  # the last batch comes again
    assert last != 2 or same()
    assert len(gridding._versions(spark, path)) == 2


# ---------------------------------------------------------------- contracts of the data


def test_star_forming_gas_has_no_weight_and_y_is_kept(spark, simulation):
    rows = grid.of_type(simulation.particles, "gas").withColumnsRenamed({"density": "densities", "internal_energy": "compton_y"})
    rows = rows.withColumn("star_forming", F.col("particle_id") % 3 == 0).withColumns({c: F.when(F.col("star_forming"), 0.0).otherwise(F.col(o)) for c, o in (("electron_number_density", "electron_abundance"), ("compton_y", "compton_y"))})
    from skyweave.functions import physics

    h, pixel = simulation.header, 2.5e50
    weights = physics.sz_from_catalogue(h.h, h.a, pixel)
    t, y = weights["tau"], weights["tSZ"]
    sums = rows.groupBy("star_forming").agg(F.sum(t).alias("tau"), F.sum(y).alias("y"), F.sum("compton_y").alias("given")).collect()
    by = {r["star_forming"]: r for r in sums}
    assert by[True]["tau"] == 0 and by[True]["y"] == 0 and by[False]["tau"] > 0
    field = grid.nearest_grid(rows, y, h.box, 16)
    given = field.agg(F.sum("value")).head()[0] * pixel / 3.0856775814913674e24**2
    assert math.isclose(given, by[False]["given"], rel_tol=1e-9)


def test_density_of_particles_against_the_header(simulation):
    """The mass in 3D cells over the box's volume is the particles' mean density, whatever the grid."""
    rows = grid.of_type(simulation.particles, "total")
    mass = rows.agg(F.sum("mass")).head()[0]
    for n in (4, 8):
        cells_ = grid.tsc_grid(rows, F.col("mass"), simulation.header.box, n)
        mean = cells_.agg(F.sum("value")).head()[0] / n**3 / (simulation.header.box / n) ** 3
        assert math.isclose(mean, mass / simulation.header.box**3, rel_tol=1e-9)
    counted = stats.mean_profile(rows.withColumn("radius", F.lit(1.0)), "mass").head()
    assert counted["n"] == rows.count()
