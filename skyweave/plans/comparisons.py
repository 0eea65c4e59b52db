"""Queries of the comparison analyses: components, samples side by side, beam sweeps, spheres and regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.cosmology import comoving_to_arcmin
from ..operators import beam, filters, grid, many, masks, selection, stats, tiles
from ..sources import cells
from ..sources.fixtures import HEADER as H
from ..sources.scratch import scratch
from . import sql as s
from .registry import _OFF, _PER, _REL, F_B, RADII, TARGET, UPPER, _by_sim, _chosen, _cum, _h, _many, _many_sql, _p, _round, _stack, query

# ---------------------------------------------------------------- components and samples

_PARTS = ("gas", "Stars", "BH", "DM")
_ALL = [*_PARTS, "total"]


def _component_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each component's mean over that of all matter, in units of the baryon fraction; radius 0 says nothing."""
    means = _many(spark, d, _ALL).where("radius > 0").groupBy("radius").agg(*[F.avg(t).alias(t) for t in _ALL])
    shares = means.select("radius", *[(F.try_divide(F.col(t), F.col("total")) / F.lit(F_B)).alias(t) for t in _PARTS])
    return _round(shares.unpivot("radius", list(_PARTS), "ptype", "share"), "share")


query("component_shares", _many_sql(" UNION ALL ".join(f"SELECT radius, '{t}' AS ptype, round(a.m / nullif(b.m, 0) / {F_B!r}::DOUBLE, 6) AS share FROM m_{t} a JOIN m_total b USING (radius)" for t in _PARTS), _ALL))(_component_shares)


def _star_fraction_in_spheres(spark: SparkSession, d: str) -> DataFrame:
    """Stars over baryons in spheres of one radius, four times the sample's mean; overlaps count again."""
    objects = _chosen(spark, d)
    centres = masks.centre_cells(objects.crossJoin(objects.agg(F.avg("group_rad").alias("mean_rad"))), H.box, 32, F.col("mean_rad") * 4)
    rows = grid.of_type(_p(spark, d), "baryon").withColumn("star", F.when(F.col("ptype") == "Stars", F.col("mass")).otherwise(F.lit(0.0)))
    found = rows.groupBy(*[grid.cell(a, H.box, 32).alias(c) for a, c in zip("xyz", "ijk", strict=True)]).agg(F.sum("star").alias("stars"), F.sum("mass").alias("baryons"))
    sums = masks.sums_over_balls(found, centres, 32, ["group_id"], ["stars", "baryons"])
    return sums.agg(F.sum("stars").alias("stars"), F.sum("baryons").alias("baryons"), F.round(F.try_divide(F.sum("stars"), F.sum("baryons")), 9).alias("fraction"))


_MEAN_BALL = """ball AS (SELECT group_id, (((round_even(pos_x / 3200.0, 0)::INT + di) % 32 + 32) % 32)::INT AS i, (((round_even(pos_y / 3200.0, 0)::INT + dj) % 32 + 32) % 32)::INT AS j, (((round_even(pos_z / 3200.0, 0)::INT + dk) % 32 + 32) % 32)::INT AS k
  FROM chosen, off, (SELECT avg(group_rad) * 4 / 3200.0 AS r FROM chosen) WHERE di * di + dj * dj + dk * dk <= r * r)"""
_BARYONS = f"baryons AS (SELECT {s.bin_of('x', 32)} AS i, {s.bin_of('y', 32)} AS j, {s.bin_of('z', 32)} AS k, sum(CASE WHEN ptype = 'Stars' THEN mass ELSE 0.0 END) AS stars, sum(mass) AS mass FROM particles WHERE ptype IN {s.TYPES['baryon']} GROUP BY ALL)"
query("star_fraction_in_spheres", s.q(s.massive(TARGET, UPPER), _OFF, _MEAN_BALL, _BARYONS, "SELECT sum(stars) AS stars, sum(mass) AS baryons, round(sum(stars) / nullif(sum(mass), 0), 9) AS fraction FROM ball JOIN baryons USING (i, j, k)"))(_star_fraction_in_spheres)

_FEW = 20


def _samples_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of several samples in one job; samples of fewer than 20 objects are marked."""
    p = _stack(spark, d, "CAP").withColumn("sim", F.col("group_id") % 12)
    return _round(stats.mean_profile(p, by=("sim", "radius")).withColumn("few", F.col("n") < _FEW), "mean", "err")


_CAP = lambda final: s.q(s.massive(TARGET, UPPER), s.field("gas"), s.stencil("CAP", RADII, _PER), s.filter_weights("CAP"), s.profile(), final)
query("samples_side_by_side", _CAP(f"SELECT object_id % 12 AS sim, radius, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) AS err, count(value)::BIGINT AS n, count(value) < {_FEW} AS few FROM profile GROUP BY ALL"))(_samples_side_by_side)
query("beam_factor_error", _cum(f"SELECT a.radius, round(a.m / nullif(b.m, 0), 6) AS ratio, round(abs(a.m / nullif(b.m, 0)) * sqrt({_REL}), 6) AS err FROM (SELECT radius, avg(beamed) AS m, stddev_pop(beamed) / sqrt(count(beamed)) AS e FROM sims GROUP BY radius) a JOIN (SELECT radius, avg(bare) AS m, stddev_pop(bare) / sqrt(count(bare)) AS e FROM sims GROUP BY radius) b ON a.radius = b.radius"))(
    lambda sp, d: (lambda p: _round(stats.ratio(stats.mean_profile(p, "beamed"), stats.mean_profile(p, "bare")), "ratio", "err"))(_by_sim(sp, d))
)


def _finite_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Per-object ratios that are finite, up to a largest radius."""
    p = _many(spark, d, ["BH", "Stars"]).select("group_id", "radius", F.try_divide(F.col("BH"), F.col("Stars")).alias("value"))
    return selection.finite(p, "value").where("radius <= 4.1").groupBy("radius").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


query("finite_ratios", _many_sql("SELECT radius, count(*)::BIGINT AS n, round(avg(v), 6) AS mean FROM (SELECT a.radius, a.value / nullif(b.value, 0) AS v FROM p_BH a JOIN p_Stars b USING (object_id, radius)) WHERE v IS NOT NULL AND isfinite(v) AND radius <= 4.1 GROUP BY radius", ["BH", "Stars"]))(_finite_ratios)


def _taper(r: np.ndarray, at: float) -> np.ndarray:
    """A filter of the caller's own: a cone that falls to 0 at the radius."""
    return np.clip(1 - r / at, 0, None)


query("own_filter_stack", s.q(s.massive(TARGET, UPPER), s.field("gas"), s.stencil("cumulative", RADII, _PER), "w AS (SELECT radius, di, dj, greatest(1 - r / radius, 0.0) AS w FROM pixel, radii)", s.profile(), s.MEAN_SE))(lambda sp, d: _round(stats.mean_profile(_stack(sp, d, _taper)), "mean", "err"))
_KERNEL_DR = 0.5
_KERNEL = f"(CASE WHEN r < radius THEN 1.0 / (pi() * radius * radius) WHEN r < radius + {_KERNEL_DR} THEN -1.0 / (pi() * (power(radius + {_KERNEL_DR}, 2) - radius * radius)) ELSE 0.0 END)"
query("dsigma_kernel_map_stack", s.q(s.massive(TARGET, UPPER), s.field("gas"), s.stencil("DSigma_kernel_map", RADII, _PER), f"w AS (SELECT radius, di, dj, {_KERNEL} - avg({_KERNEL}) OVER (PARTITION BY radius) AS w FROM pixel, radii)", s.profile(), s.MEAN_SE))(
    lambda sp, d: _round(stats.mean_profile(_stack(sp, d, lambda r, at: filters.weights("DSigma_kernel_map", r, at, dr=_KERNEL_DR))), "mean", "err")
)

# ---------------------------------------------------------------- beams

_BEAMS = (4800.0, 6400.0)


def _smooth_sql(kernels: dict[str, str], final: str) -> str:
    parts = [s.field("gas", n=32)]
    for name, kernel in kernels.items():
        parts.append(kernel)
        parts.append(f"half{name} AS (SELECT ((i + d) % 32)::INT AS i, j, sum(value * w) AS value FROM field, kern{name} GROUP BY (i + d) % 32, j)")
        parts.append(f"map{name} AS (SELECT ((j + d) % 32)::INT AS j, i, sum(value * w) AS value FROM half{name}, kern{name} GROUP BY (j + d) % 32, i)")
    return s.q(*parts, final)


def _beam_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One field under several beams."""
    f = grid.field(_p(spark, d), "gas", H, 32, unit=1.0)
    maps = [beam.convolve(f, beam.fourier_kernel(32, b, 3200.0)).withColumn("fwhm", F.lit(b)) for b in _BEAMS]
    return _round(maps[0].unionByName(maps[1]).select("fwhm", "i", "j", "value"), "value")


query("map_beam_sweep", _smooth_sql({str(i): s.beam_kernel(32, b, 3200.0, f"kern{i}") for i, b in enumerate(_BEAMS)}, " UNION ALL ".join(f"SELECT {b!r}::DOUBLE AS fwhm, i, j, round(value, 6) AS value FROM map{i}" for i, b in enumerate(_BEAMS))))(_beam_sweep)
_GAUSS = beam.gaussian_kernel(32, 6400.0, 3200.0)
query("map_gaussian_smooth", _smooth_sql({"": s.gaussian(32, 6400.0, 3200.0)}, "SELECT i, j, round(value, 6) AS value FROM map"))(lambda sp, d: _round(beam.convolve(grid.field(_p(sp, d), "gas", H, 32, unit=1.0), _GAUSS), "value"))

# ---------------------------------------------------------------- scalars

query("right_wrap", s.q("SELECT group_id, CASE WHEN pos_x + group_rad * 20 >= 102400.0 THEN pos_x + group_rad * 20 - 102400.0 ELSE pos_x + group_rad * 20 END AS x FROM halos"))(lambda sp, d: _h(sp, d).select("group_id", physics.right_wrap(F.col("pos_x") + F.col("group_rad") * 20, H.box).alias("x")))
_ARCMIN = comoving_to_arcmin(1.0, H.z)
query("radius_arcmin", s.q(s.comoving(0.6766, 0.30966, H.z), "SELECT group_id, round(group_rad * degrees(1 / 0.6766::DOUBLE / 1000 / mpc) * 60, 9) AS theta FROM halos, distance"))(lambda sp, d: _h(sp, d).select("group_id", F.round(F.col("group_rad") * F.lit(_ARCMIN), 9).alias("theta")))
_BASE = 64


def _equal_cells(spark: SparkSession, d: str) -> DataFrame:
    """Grids of cells of one size over the extents of the particle types, which are a few."""
    rows = _p(spark, d).where("ptype IS NOT NULL").groupBy("ptype").agg((F.max("x") - F.min("x") + F.count("*")).alias("box")).orderBy("ptype").collect()
    sizes = physics.equal_cell_grids([r["box"] for r in rows], _BASE)
    return spark.createDataFrame([(r["ptype"], r["box"], n) for r, n in zip(rows, sizes, strict=True)], "ptype string, box double, n long")


query("equal_cell_grids", s.q("boxes AS (SELECT ptype, max(x) - min(x) + count(*) AS box FROM particles WHERE ptype IS NOT NULL GROUP BY ptype)", "smooth AS (SELECT DISTINCT (power(2, a) * power(3, b) * power(5, c) * power(7, e))::BIGINT AS n FROM (SELECT unnest(range(12)) AS a), (SELECT unnest(range(8)) AS b), (SELECT unnest(range(6)) AS c), (SELECT unnest(range(5)) AS e))",
    f"near AS (SELECT ptype, box, n, row_number() OVER (PARTITION BY ptype ORDER BY abs(n - round_even({_BASE} * box / (SELECT min(box) FROM boxes), 0)), n) AS place FROM boxes, smooth)", "SELECT ptype, box, n FROM near WHERE place = 1"))(_equal_cells)

# ---------------------------------------------------------------- regions and spectra

_CENTRE, _REACH = (30000.0, 101000.0, 52000.0), 18000.0
_NEAR = " + ".join(f"power({x} - {c!r} - 102400.0 * round_even(({x} - {c!r}) / 102400.0, 0), 2)" for x, c in zip("xyz", _CENTRE, strict=True))


def _region(spark: SparkSession, d: str) -> DataFrame:
    """Particles of one periodic sphere, read from the coarse cells that it meets."""
    path = cells.write(_p(spark, d).where("ptype IS NOT NULL").select("particle_id", "ptype", "x", "y", "z", "mass"), scratch(spark, "cells"), H.box, 8)
    return cells.read_sphere(spark, path, _CENTRE, _REACH, H.box, 8).groupBy("ptype").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))


query("cell_pruned_sphere", s.q(f"SELECT ptype, count(*)::BIGINT AS n, sum(mass) AS mass FROM particles WHERE ptype IS NOT NULL AND {_NEAR} < {_REACH**2!r} GROUP BY ptype"))(_region)


_MASKED_N = 16


def _masked_pk(spark: SparkSession, d: str) -> DataFrame:
    """The spectrum of what lies around massive halos, as an overdensity of the masked field."""
    n = _MASKED_N
    near = masks.masked(grid.nearest_grid_3d(_p(spark, d).where("ptype IS NOT NULL"), F.col("mass"), H.box, n), masks.centre_cells(_chosen(spark, d), H.box, n, F.col("group_rad") * 8), n)
    modes = tiles.transform(tiles.overdensity(tiles.kept(tiles.filled(near, (n, n, n)))))
    return _round(_round(tiles.power(modes, None, H.box / 1e3, mas=False), "k", digits=9), "p")


_BALL16 = """centres AS (SELECT round_even(pos_x / 6400.0, 0)::INT AS ci, round_even(pos_y / 6400.0, 0)::INT AS cj, round_even(pos_z / 6400.0, 0)::INT AS ck, group_rad * 8 / 6400.0 AS r FROM chosen),
ball AS (SELECT DISTINCT (((ci + di) % 16 + 16) % 16)::INT AS i, (((cj + dj) % 16 + 16) % 16)::INT AS j, (((ck + dk) % 16 + 16) % 16)::INT AS k FROM centres, off WHERE di * di + dj * dj + dk * dk <= r * r)"""
_NEAR16 = f"near AS (SELECT {s.bin_of('x', 16)} AS i, {s.bin_of('y', 16)} AS j, {s.bin_of('z', 16)} AS k, sum(mass) AS value FROM particles WHERE ptype IS NOT NULL GROUP BY ALL), inside AS (SELECT * FROM near WHERE (i, j, k) IN (SELECT (i, j, k) FROM ball)), f_near AS (SELECT i, j, k, value / (SELECT sum(value) / 4096.0 FROM inside) AS re, 0.0::DOUBLE AS im FROM inside)"
query("masked_pk", s.q(s.massive(TARGET, UPPER), _OFF, _BALL16, _NEAR16, s.dft("f_near", "t_near", 16), s.power("t_near", "t_near", "pk", 16, H.box / 1e3, mas=False), "SELECT bin, round(k, 9) AS k, round(p, 6) AS p, n_modes FROM pk"))(_masked_pk)

# ---------------------------------------------------------------- simulations of different boxes in one plan

_BOXES_AT = [("wide", 102400.0, 64, 0.6774, 0.5), ("small", 51200.0, 40, 0.7, 1.0)]
_MANY_RADII = [1.05, 2.05, 3.05]


def _two_boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Particles and halos of two simulations: the whole box, and its lower octant with everything folded into it."""
    table = many.headers(spark, _BOXES_AT)
    fold = lambda rows, cols: rows.withColumn("sim", F.lit("wide")).unionByName(rows.withColumns({c: F.col(c) % 51200 for c in cols}).withColumn("sim", F.lit("small")))
    return fold(_p(spark, d), ("x", "y", "z")), fold(selection.half_open(_h(spark, d), 3), ("pos_x", "pos_y", "pos_z")), table


def _many_stack(spark: SparkSession, d: str, filter_type: str, ptype: str, scale: float = 1.0) -> DataFrame:
    rows, objects, table = _two_boxes(spark, d)
    got = many.profiles(many.fields(rows, table, ptype, unit=1.0), objects, table, filter_type, _MANY_RADII, 1000.0)
    return _round(stats.mean_profile(got.withColumn("value", F.col("value") * F.lit(scale)), by=("sim", "radius")), "mean", "err")


def _one_by_one(filter_type: str, value: str, area: bool) -> str:
    """Each simulation by a query of its own."""
    parts, finals = [], []
    low, high = selection.mass_bin(3)
    for name, box, n, _, _ in _BOXES_AT:
        cell = box / n
        own = {x: f"fmod({x}, {box!r}::DOUBLE)" for x in "xyz"}
        text = s.q(
            f"rows_{name} AS (SELECT * REPLACE ({', '.join(f'{e} AS {x}' for x, e in own.items())}) FROM particles WHERE ptype = 'gas')",
            f"chosen_{name} AS (SELECT * REPLACE ({', '.join(f'fmod(pos_{x}, {box!r}::DOUBLE) AS pos_{x}' for x in 'xyz')}) FROM halos WHERE group_mass >= {low!r} AND group_mass < {high!r})",
            f"field_{name} AS (SELECT least(floor(x * {n} / {box!r}::DOUBLE), {n - 1})::INT AS i, least(floor(y * {n} / {box!r}::DOUBLE), {n - 1})::INT AS j, sum({value}) AS value FROM rows_{name} GROUP BY ALL)",
            *[p.replace("square", f"square_{name}").replace("pixel AS", f"pixel_{name} AS").replace("radii AS", f"radii_{name} AS") for p in [s.stencil(filter_type, np.array(_MANY_RADII), 1000.0 / cell)]],
            s.filter_weights(filter_type, 3 * cell / 1000.0, cell**2 if area else 1.0).replace("w AS (SELECT radius", f"w_{name} AS (SELECT radius").replace("FROM pixel, radii", f"FROM pixel_{name}, radii_{name}"),
            s.profile(f"chosen_{name}", name=f"profile_{name}", source=f"field_{name}", n=n, cell=cell).replace(" c, w)", f" c, w_{name} w)"),
            "SELECT 1",
        )
        parts.append(text[text.index(f"rows_{name} AS") : text.rindex("SELECT 1")].rstrip().rstrip(","))
        finals.append(f"SELECT '{name}' AS sim, radius, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) AS err, count(value)::BIGINT AS n FROM profile_{name} GROUP BY radius")
    return s.q(*parts, " UNION ALL ".join(finals))


query("two_boxes_cap", _one_by_one("CAP", "mass", False))(lambda sp, d: _many_stack(sp, d, "CAP", "gas"))
query("two_boxes_dsigma", _one_by_one("DSigma", "mass * 1e6", True))(lambda sp, d: _many_stack(sp, d, "DSigma", "gas", 1e6))
