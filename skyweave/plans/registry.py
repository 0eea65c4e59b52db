"""Registered queries over the synthetic tables, and the SQL that says what each must return."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import physics
from ..functions.cosmology import Flat, map_pixels
from ..operators import beam, filters, grid, masks, selection, spectra, stack, stats, tiles
from ..sources import fixtures, suites
from ..sources.fixtures import HEADER as H
from ..sources.scratch import stored
from . import sql as s
from .facade import Simulation

FLAGSHIP = "cap_stack_gas"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}

TARGET, UPPER = 8.5e13, 9.5e13
UNIT = 1000.0
RADII = np.array([1.05, 2.05, 3.05, 4.05, 5.05])
F_B = H.omega_b / H.omega_m
SUBHALO_DENSITY = 1e-4


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _p(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.particles(spark, d)


def _h(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.halos(spark, d)


def _sub(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.subhalos(spark, d)


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    return selection.massive(_h(spark, d), TARGET, UPPER)


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---------------------------------------------------------------- sources

query("particles_normalised", s.q("SELECT ptype, count(*)::BIGINT AS n, sum(mass) AS mass, min(x) AS min_x, max(z) AS max_z FROM particles GROUP BY ptype"))(
    lambda sp, d: _p(sp, d).groupBy("ptype").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.min("x").alias("min_x"), F.max("z").alias("max_z"))
)
query("dm_constant_mass", s.q("SELECT count(*)::BIGINT AS n, sum(7.5::DOUBLE) AS mass FROM particles WHERE ptype = 'DM'"))(
    lambda sp, d: suites.constant_mass(grid.of_type(_p(sp, d), "DM").drop("mass"), [0.0, 7.5]).agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
)
query("suite_c_particle_units", s.q("SELECT ptype, sum(x * 1000 * 0.5) AS x, sum(mass * 0.5) AS mass FROM particles GROUP BY ptype"))(
    lambda sp, d: suites.particles_c(_p(sp, d), h=0.5).groupBy("ptype").agg(F.sum("x").alias("x"), F.sum("mass").alias("mass"))
)

def _suite_c(spark: SparkSession, d: str) -> DataFrame:
    """Gas whose catalogue has y times area and electron densities: three effects and the ionized mass, by cell."""
    rows = grid.of_type(_p(spark, d), "gas").withColumnsRenamed({"density": "densities", "electron_abundance": "electron_number_density", "internal_energy": "compton_y"}).withColumns({"vx": F.col("vz") * 2.0, "vy": -F.col("vz")})
    weights = {**physics.sz_from_catalogue(H.h, H.a, 1e-24), "ionized": physics.ionized_mass_from_density(H.h, H.a)}
    scale = {"tSZ": 1e-78, "tau": 1.0, "kSZ_x": 1e9, "kSZ_y": 1e9, "kSZ_z": 1e9, "ionized": 1e57}
    sums = rows.select(grid.cell("x", H.box, 8).alias("i"), grid.cell("y", H.box, 8).alias("j"), *[w.alias(x) for x, w in weights.items()]).groupBy("i", "j")
    return _round(sums.agg(*[(F.sum(x) * F.lit(scale[x])).alias(x) for x in weights]), *weights, digits=4)


_NE = "electron_abundance * (mass / 0.6774::DOUBLE / density) * power(1 / 1.5::DOUBLE, 3)"
_TAU_C = f"{_NE} * 6.6524587158e-25::DOUBLE / 1e-24::DOUBLE"
query("sz_suite_c", s.q(f"SELECT {s.bin_of('x', 8)} AS i, {s.bin_of('y', 8)} AS j, round(sum(internal_energy * power(3.0856775814913674e24::DOUBLE, 2) / 1e-24::DOUBLE) * 1e-78::DOUBLE, 4) AS \"tSZ\", round(sum({_TAU_C}), 4) AS tau, round(sum({_TAU_C} * 2 * vz / 29979245800.0::DOUBLE) * 1e9, 4) AS \"kSZ_x\", round(sum({_TAU_C} * -vz / 29979245800.0::DOUBLE) * 1e9, 4) AS \"kSZ_y\", round(sum({_TAU_C} * vz / 29979245800.0::DOUBLE) * 1e9, 4) AS \"kSZ_z\", round(sum({_NE} * 1.6726e-24::DOUBLE * 2 / 1.76::DOUBLE / 1.989e33::DOUBLE * 0.6774::DOUBLE) * 1e57::DOUBLE, 4) AS ionized FROM particles WHERE ptype = 'gas' GROUP BY ALL"))(_suite_c)
query("halo_catalog", s.q("SELECT group_id, pos_x, pos_y, pos_z, group_mass, group_rad FROM halos"))(_h)
query("subhalo_catalog_fk", s.q("SELECT s.subhalo_id, s.parent_group_id, s.pos_x, s.pos_y, s.pos_z, round(h.group_mass, 0) AS host_mass FROM subhalos s JOIN halos h ON s.parent_group_id = h.group_id"))(
    lambda sp, d: _sub(sp, d).alias("s").join(_h(sp, d).alias("h"), F.col("parent_group_id") == F.col("group_id")).select("subhalo_id", "parent_group_id", "s.pos_x", "s.pos_y", "s.pos_z", F.round("group_mass", 0).alias("host_mass"))
)
query("central_rank", "SELECT o_orderkey AS row_id, o_orderkey % 3 = 0 AS is_central, (sum((o_orderkey % 3 = 0)::BIGINT) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS central_rank, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey - o_orderkey % 3 END AS parent_row FROM orders")(
    lambda sp, d: selection.central_rank(fixtures.table(sp, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 3 == 0).alias("is_central"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("o_orderkey") - F.col("o_orderkey") % 3).alias("host_row")))
)

# ---------------------------------------------------------------- selection

for _i, (_low, _high) in k.MASS_BINS.items():
    query(f"bins_select_{_i}", s.q(f"SELECT group_id, group_mass FROM halos WHERE group_mass > {_low!r} AND group_mass < {_high!r}"))(lambda sp, d, i=_i: selection.binned(_h(sp, d), i).select("group_id", "group_mass"))
query("bins_select_half_open", s.q("SELECT group_id, group_mass FROM halos WHERE group_mass >= 1e12 AND group_mass < 1e13"))(lambda sp, d: selection.half_open(_h(sp, d), 1).select("group_id", "group_mass"))
query("massive_select", s.q(s.massive(TARGET, UPPER), "SELECT group_id, group_mass FROM chosen"))(lambda sp, d: _chosen(sp, d).select("group_id", "group_mass"))
query("abundance_select", s.q("SELECT subhalo_id, subhalo_mstar FROM subhalos ORDER BY subhalo_mstar DESC, subhalo_id LIMIT 107"))(lambda sp, d: selection.abundance(_sub(sp, d), H.box, SUBHALO_DENSITY).select("subhalo_id", "subhalo_mstar"))
_SHAM = f"sham AS (SELECT s.* FROM subhalos s WHERE parent_group_id IN (SELECT group_id FROM halos WHERE group_mass <= {UPPER}) ORDER BY subhalo_mstar DESC, subhalo_id LIMIT 107)"


def _sham(spark: SparkSession, d: str) -> DataFrame:
    return selection.abundance_of_subhalos(_sub(spark, d), _h(spark, d), H.box, SUBHALO_DENSITY, UPPER)


query("sham_parent_prefilter", s.q(_SHAM, "SELECT subhalo_id, parent_group_id, subhalo_mstar FROM sham"))(lambda sp, d: _sham(sp, d).select("subhalo_id", "parent_group_id", "subhalo_mstar"))
query("sham_parent_stats", s.q(_SHAM, "SELECT count(*)::BIGINT AS n, round(avg(group_mass) / 1e10, 4) AS mean_mass, round(avg(group_rad), 6) AS mean_radius FROM sham JOIN halos ON parent_group_id = group_id"))(
    lambda sp, d: selection.parent_stats(_sham(sp, d), _h(sp, d)).select("n", F.round(F.col("mean_mass") / 1e10, 4).alias("mean_mass"), F.round("mean_radius", 6).alias("mean_radius"))
)
query("central_satellite_stats", s.q(_SHAM, "top AS (SELECT parent_group_id AS g, max(subhalo_mass) AS top FROM subhalos GROUP BY 1)", """flag AS (SELECT subhalo_id AS sid, abs(subhalo_mass - top) <= 1e-8 + 1e-5 * top AS central FROM subhalos JOIN top ON parent_group_id = g),
hosts AS (SELECT count(*)::BIGINT AS n_hosts, round(avg(group_mass) / 1e10, 4) AS mean_host_mass FROM halos WHERE group_id IN (SELECT parent_group_id FROM sham))
SELECT count(*)::BIGINT AS n, round(avg(subhalo_mass) / 1e10, 4) AS mean_mass, round(avg(CASE WHEN central THEN 0.0 ELSE 1.0 END), 6) AS satellite_fraction, max(n_hosts) AS n_hosts, max(mean_host_mass) AS mean_host_mass FROM sham JOIN flag ON sid = subhalo_id, hosts"""))(
    lambda sp, d: selection.selection_stats(_sham(sp, d), _sub(sp, d), _h(sp, d)).select("n", F.round(F.col("mean_mass") / 1e10, 4).alias("mean_mass"), F.round("satellite_fraction", 6).alias("satellite_fraction"), "n_hosts", F.round(F.col("mean_host_mass") / 1e10, 4).alias("mean_host_mass"))
)
query("semi_join_override", s.q("SELECT group_id, group_mass FROM halos WHERE group_id IN (SELECT group_id FROM halos WHERE group_rad > 1500)"))(lambda sp, d: selection.chosen(_h(sp, d), _h(sp, d).where("group_rad > 1500"), "group_id").select("group_id", "group_mass"))
query("mean_radius_unit", s.q("SELECT round(avg(group_rad), 6) AS mean_radius FROM halos WHERE group_mass > 1e13 AND group_mass < 1e19"))(lambda sp, d: _round(selection.mean_radius(_h(sp, d)), "mean_radius"))

# ---------------------------------------------------------------- fields

for _t in ("gas", "DM", "Stars", "BH", "total", "baryon"):
    query(f"field_{_t.lower()}", s.q(s.field(_t), "SELECT i, j, value FROM field"))(lambda sp, d, t=_t: grid.field(_p(sp, d), t, H, unit=1.0))
for _pr in ("xz", "yz"):
    query(f"field_gas_{_pr}", s.q(s.field("gas", projection=_pr), "SELECT i, j, value FROM field"))(lambda sp, d, pr=_pr: grid.field(_p(sp, d), "gas", H, projection=pr, unit=1.0))
_ION = f"mass * electron_abundance * {k.X_H * 2 / (1 + k.X_H)!r}::DOUBLE"
query("field_ionized", s.q(s.field("gas", value=_ION), "SELECT i, j, round(value, 6) AS value FROM field"))(lambda sp, d: _round(grid.field(_p(sp, d), "ionized_gas", H, unit=1.0), "value"))
query("field_neutral", s.q(s.field("gas", value=f"mass - {_ION}"), "SELECT i, j, round(value, 6) AS value FROM field"))(lambda sp, d: _round(grid.field(_p(sp, d), "neutral_gas", H, unit=1.0), "value"))
_NE = f"electron_abundance * {k.X_H * (1e10 * (k.SOLAR_MASS / H.h) / (k.KPC_CM / H.h) ** 3) / k.M_P!r}::DOUBLE * density * (mass / density) * {(k.KPC_CM / H.h) ** 3 / physics.pixel_area_cm2(H.box, H.n, H.h, H.a)!r}::DOUBLE"
_TE = f"{(k.GAMMA - 1) / k.K_B * 4 * k.M_P * k.UNIT_C!r}::DOUBLE * internal_energy / ({1 + 3 * k.X_H!r}::DOUBLE + {4 * k.X_H!r}::DOUBLE * electron_abundance)"
_SZ = {"tau": (f"{_NE} * {k.SIGMA_T!r}::DOUBLE", 1e6), "tSZ": (f"{_NE} * ({_TE}) * {k.K_B * k.SIGMA_T / (k.M_E * k.C**2)!r}::DOUBLE", 1e9), "kSZ": (f"{_NE} * {k.SIGMA_T!r}::DOUBLE * vz * {math.sqrt(H.a) / k.C!r}::DOUBLE", 1e12)}
for _t, (_v, _scale) in _SZ.items():
    _name = {"kSZ": "field_ksz_los"}.get(_t, f"field_{_t.lower()}")
    query(_name, s.q(s.field("gas", value=_v), f"SELECT i, j, round(value * {_scale!r}::DOUBLE, 5) AS value FROM field"))(lambda sp, d, t=_t, c=_scale: grid.field(_p(sp, d), t, H).withColumn("value", F.round(F.col("value") * F.lit(c), 5)))
query("field_hist_exclusive", s.q(f"SELECT {s.bin_of('x')} AS i, {s.bin_of('y')} AS j, count(*)::DOUBLE AS value FROM particles WHERE x < 102400 AND y < 102400 GROUP BY ALL"))(lambda sp, d: grid.nearest_grid(_p(sp, d), F.lit(1.0), H.box, H.n, right_edge=False))


def _tsc_sql(dims: str, n: int, ptype: str) -> str:
    axis = lambda d, c: f"{c} AS (SELECT * EXCLUDE (s), ((((round_even({d} / 102400.0 * {n}, 0)::INT + s) % {n}) + {n}) % {n})::INT AS c{d}, CASE s WHEN 0 THEN 0.75 - power(g, 2) WHEN -1 THEN 0.5 * power(0.5 + g, 2) ELSE 0.5 * power(0.5 - g, 2) END AS w{d} FROM (SELECT p.*, s.s, round_even({d} / 102400.0 * {n}, 0) - {d} / 102400.0 * {n} AS g FROM {{}} p, (SELECT unnest([-1, 0, 1]) AS s) s))"
    parts, source = [f"own AS (SELECT x, y, z, mass FROM particles WHERE ptype IN {s.TYPES.get(ptype, f"('{ptype}')")})"], "own"
    for d in dims:
        parts.append(axis(d, f"t{d}").format(source).replace("EXCLUDE (s)", "EXCLUDE (s, g)"))
        source = f"t{d}"
    w = " * ".join(f"w{d}" for d in dims)
    return s.q(*parts, f"SELECT {', '.join(f'c{d} AS {n_}' for d, n_ in zip(dims, 'ijk', strict=False))}, round(sum(mass * {w}), 6) AS value FROM {source} GROUP BY {', '.join(f'c{d}' for d in dims)}")


query("field_tsc_2d", _tsc_sql("xy", 32, "gas"))(lambda sp, d: _round(grid.tsc_grid(grid.of_type(_p(sp, d), "gas"), F.col("mass"), H.box, 32, ("x", "y")), "value"))
query("field_tsc_3d", _tsc_sql("xyz", 16, "Stars"))(lambda sp, d: _round(grid.tsc_grid(grid.of_type(_p(sp, d), "Stars"), F.col("mass"), H.box, 16), "value"))
_F3 = f"field3 AS (SELECT {s.bin_of('x', 32)} AS i, {s.bin_of('y', 32)} AS j, {s.bin_of('z', 32)} AS k, sum(mass) AS value FROM particles GROUP BY ALL)"


def _f3(spark: SparkSession, d: str) -> DataFrame:
    return grid.nearest_grid_3d(_p(spark, d).where(F.col("ptype").isNotNull()), F.col("mass"), H.box, 32)


query("los_projection", s.q(_F3, "SELECT i, k AS j, sum(value) AS value FROM field3 GROUP BY i, k"))(lambda sp, d: grid.project(_f3(sp, d), "xz"))
_DENSE = "cells AS (SELECT a.i::INT AS i, b.i::INT AS j FROM (SELECT unnest(range(64)) AS i) a, (SELECT unnest(range(64)) AS i) b), filled AS (SELECT c.i, c.j, coalesce(value, 0.0) AS value FROM cells c LEFT JOIN field f ON c.i = f.i AND c.j = f.j)"
query("mean_subtract", s.q(s.field("gas"), _DENSE, "SELECT i, j, round(value - (SELECT sum(value) / 4096.0 FROM field), 6) AS value FROM filled"))(lambda sp, d: _round(grid.subtract_mean(grid.field(_p(sp, d), "gas", H, unit=1.0), H.n), "value"))
query("overdensity", s.q(s.field("DM"), _DENSE, "SELECT i, j, round(value / (SELECT sum(value) / 4096.0 FROM field) - 1, 6) AS value FROM filled"))(lambda sp, d: _round(grid.overdensity(grid.field(_p(sp, d), "DM", H, unit=1.0), H.n), "value"))
# the same grids as tiles
query("los_projection_tiles", s.q(_F3, "SELECT i, k AS j, sum(value) AS value FROM field3 GROUP BY i, k"))(lambda sp, d: tiles.cells(tiles.projected(tiles.filled(_f3(sp, d), (32, 32, 32)), "j"), keep=lambda a: a != 0).withColumnRenamed("k", "j"))
query("overdensity_tiles", s.q(s.field("DM"), _DENSE, "SELECT i, j, round(value / (SELECT sum(value) / 4096.0 FROM field) - 1, 6) AS value FROM filled"))(lambda sp, d: _round(tiles.cells(tiles.overdensity(tiles.kept(tiles.filled(grid.field(_p(sp, d), "DM", H, unit=1.0), (H.n, H.n))))), "value"))
query("star_fraction", s.q("SELECT sum(mass) FILTER (WHERE ptype = 'Stars') AS stars, sum(mass) FILTER (WHERE ptype <> 'DM') AS baryons, round(sum(mass) FILTER (WHERE ptype = 'Stars') / sum(mass) FILTER (WHERE ptype <> 'DM'), 9) AS fraction FROM particles"))(lambda sp, d: _round(grid.star_fraction(_p(sp, d)), "fraction", digits=9))

# ---------------------------------------------------------------- masks

_CENTRES = "centres AS (SELECT group_id, round_even(pos_x / 3200.0, 0)::INT AS ci, round_even(pos_y / 3200.0, 0)::INT AS cj, round_even(pos_z / 3200.0, 0)::INT AS ck, group_rad * 4 / 3200.0 AS r FROM chosen)"
_OFF = "off AS (SELECT a.d AS di, b.d AS dj, c.d AS dk FROM (SELECT unnest(range(-3, 4)) AS d) a, (SELECT unnest(range(-3, 4)) AS d) b, (SELECT unnest(range(-3, 4)) AS d) c)"
_BALL = "ball AS (SELECT group_id, (((ci + di) % 32 + 32) % 32)::INT AS i, (((cj + dj) % 32 + 32) % 32)::INT AS j, (((ck + dk) % 32 + 32) % 32)::INT AS k FROM centres, off WHERE di * di + dj * dj + dk * dk <= r * r)"


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return masks.centre_cells(_chosen(spark, d), H.box, 32, F.col("group_rad") * 4)


_M = (s.massive(TARGET, UPPER), _CENTRES, _OFF, _BALL)
query("mask_ball_3d", s.q(*_M, "SELECT DISTINCT i, j, k FROM ball"))(lambda sp, d: masks.ball_mask(_centres(sp, d), 32))
query("mask_disk_2d", s.q(s.massive(TARGET, UPPER), _CENTRES, "SELECT DISTINCT (ci + di)::INT AS i, (cj + dj)::INT AS j FROM centres, (SELECT a.d AS di, b.d AS dj FROM (SELECT unnest(range(-3, 4)) AS d) a, (SELECT unnest(range(-3, 4)) AS d) b) WHERE di * di + dj * dj <= r * r AND abs(di) <= floor(r) AND abs(dj) <= floor(r) AND ci + di BETWEEN 0 AND 31 AND cj + dj BETWEEN 0 AND 31"))(lambda sp, d: masks.disk_mask(_centres(sp, d), 32))
query("masked_field_2d", s.q(*_M, _F3, "SELECT i, j, sum(value) AS value FROM field3 WHERE (i, j, k) IN (SELECT (i, j, k) FROM ball) GROUP BY i, j"))(lambda sp, d: grid.project(masks.masked(_f3(sp, d), _centres(sp, d), 32)))
query("remaining_fraction", s.q(*_M, _F3, "o AS (SELECT coalesce(sum(value), 0.0) AS outside FROM field3 WHERE (i, j, k) NOT IN (SELECT (i, j, k) FROM ball))", "SELECT total, outside, round(outside / total, 9) AS fraction FROM (SELECT sum(value) AS total FROM field3), o"))(lambda sp, d: _round(masks.remaining_fraction(_f3(sp, d), _centres(sp, d), 32), "fraction", digits=9))
query("cutout_sums_3d", s.q(*_M, _F3, "SELECT c.group_id, coalesce(sum(value), 0.0) AS value FROM centres c LEFT JOIN ball b ON b.group_id = c.group_id LEFT JOIN field3 f ON f.i = b.i AND f.j = b.j AND f.k = b.k GROUP BY c.group_id"))(lambda sp, d: masks.sums_over_balls(_f3(sp, d), _centres(sp, d), 32, ["group_id"], ["value"]))
_EDGES = [2.3, 4.1, 6.2, 8.4]
_SPHERE = f"""sphere AS (SELECT c.group_id, e.radius, coalesce(sum(f.value), 0.0) AS value FROM chosen c CROSS JOIN (VALUES {s.numbers(_EDGES)}) e(radius)
  CROSS JOIN (SELECT a.d AS di, b.d AS dj, z.d AS dk FROM (SELECT unnest(range(-3, 4)) AS d) a, (SELECT unnest(range(-3, 4)) AS d) b, (SELECT unnest(range(-3, 4)) AS d) z) o
  LEFT JOIN field3 f ON f.i = ((round_even(pos_x / 3200.0, 0)::INT + di) % 32 + 32) % 32 AND f.j = ((round_even(pos_y / 3200.0, 0)::INT + dj) % 32 + 32) % 32 AND f.k = ((round_even(pos_z / 3200.0, 0)::INT + dk) % 32 + 32) % 32
  WHERE di * di + dj * dj + dk * dk <= power(e.radius * 1000 / 3200.0, 2) GROUP BY c.group_id, e.radius)"""
query("sphere_profile_3d", s.q(s.massive(TARGET, UPPER), _F3, _SPHERE, "SELECT group_id, radius, value FROM sphere"))(lambda sp, d: stack.sphere_profiles(_f3(sp, d), _chosen(sp, d), 32, H.box, _EDGES, UNIT))
query("shell_profile_3d", s.q(s.massive(TARGET, UPPER), _F3, _SPHERE, 'SELECT group_id, radius AS "inner", o AS "outer", v - value AS value FROM (SELECT *, lead(radius) OVER w AS o, lead(value) OVER w AS v FROM sphere WINDOW w AS (PARTITION BY group_id ORDER BY radius)) WHERE o IS NOT NULL'))(lambda sp, d: stack.shell_profile(stack.sphere_profiles(_f3(sp, d), _chosen(sp, d), 32, H.box, _EDGES, UNIT)))
_DIST = " + ".join(f"power({x} - pos_{x} - 102400.0 * round_even(({x} - pos_{x}) / 102400.0, 0), 2)" for x in "xyz")
query("min_image_sphere", s.q(s.massive(TARGET, UPPER), f"SELECT c.group_id, count(p.mass)::BIGINT AS n, coalesce(sum(p.mass), 0.0) AS mass FROM chosen c LEFT JOIN particles p ON {_DIST} < power(group_rad * 4, 2) GROUP BY c.group_id"))(
    lambda sp, d: masks.particles_in_spheres(_p(sp, d), _chosen(sp, d), H.box, F.col("group_rad") * 4, 12)
)

# ---------------------------------------------------------------- stacks

_PER = UNIT / H.cell


def _stack(spark: SparkSession, d: str, filter_type: str, ptype: str = "gas", projection: str = "xy", objects: DataFrame | None = None, key: str = "group_id", dr: float | None = None, pixel: float = 1.0, way: str | None = None) -> DataFrame:
    field = grid.field(_p(spark, d), ptype, H, projection=projection, unit=1.0)
    return stack.profiles(field, _chosen(spark, d) if objects is None else objects, H.n, H.box, filter_type, RADII, UNIT, projection, key, pixel, dr, way=way)


def _stack_sql(filter_type: str, final: str, ptype: str = "gas", projection: str = "xy", objects: str = "chosen", key: str = "group_id", dr: float = 0.0, more: tuple = (), area: float = 1.0) -> str:
    return s.q(*more, s.massive(TARGET, UPPER), s.field(ptype, projection=projection), s.stencil(filter_type, RADII, _PER), s.filter_weights(filter_type, dr, area), s.profile(objects, key, projection), final)


_NAMES = {"cumulative": "cumulative_stack", "CAP": "cap_stack_gas", "ringring": "ringring_stack", "DSigma": "dsigma_stack", "upsilon": "upsilon_stack", "DSigma_area": "dsigma_area_stack"}
#: A pixel's length in units of 100 kpc/h: an excess is over its square.
_PIXEL = H.cell / 100
for _f, _name in _NAMES.items():
    _dr, _pixel = {"DSigma": 3 / _PER, "DSigma_area": 0.75}.get(_f), _PIXEL if _f == "DSigma" else 1.0
    query(_name, _stack_sql(_f, s.MEAN_SE, dr=_dr or 0.0, area=_pixel**2))(lambda sp, d, f=_f, dr=_dr, px=_pixel: _round(stats.mean_profile(_stack(sp, d, f, dr=dr, pixel=px)), "mean", "err"))
    if _f in ("CAP", "DSigma", "upsilon"):  # the same by maps that are correlated with the weights
        query(_name + "_by_maps", _stack_sql(_f, s.MEAN_SE, dr=_dr or 0.0, area=_pixel**2))(lambda sp, d, f=_f, dr=_dr, px=_pixel: _round(stats.mean_profile(_stack(sp, d, f, dr=dr, pixel=px, way="maps")), "mean", "err"))
query("cap_stack_yz", _stack_sql("CAP", s.MEAN_SE, ptype="total", projection="yz"))(lambda sp, d: _round(stats.mean_profile(_stack(sp, d, "CAP", "total", "yz")), "mean", "err"))
query("cap_stack_subhalos", _stack_sql("CAP", s.MEAN_SE, objects="sham", key="subhalo_id", more=(_SHAM,)))(lambda sp, d: _round(stats.mean_profile(_stack(sp, d, "CAP", objects=_sham(sp, d), key="subhalo_id")), "mean", "err"))
query("cap_profiles", _stack_sql("CAP", "SELECT object_id AS group_id, radius, round(value, 6) AS value FROM profile"))(lambda sp, d: _round(_stack(sp, d, "CAP"), "value"))

_GEO = filters.Geometry.of("DSigma_mccarthy", RADII, _PER)
_HALF = round((int(max(RADII)) + 1) * _PER)  # the same by its definition
_STEP = (int(max(RADII)) + 1) / _HALF
_PIXELS = f"""cut AS (SELECT group_id AS object_id, di, dj, r, (di + {_HALF}) * {2 * _HALF + 1} + dj + {_HALF} AS tie, coalesce(value, 0.0) AS value FROM (
  SELECT c.*, di, dj, sqrt((di * di + dj * dj)::DOUBLE) * {_STEP!r}::DOUBLE AS r, (((round_even(pos_x / 1600.0, 0)::INT + di) % 64) + 64) % 64 AS ii, (((round_even(pos_y / 1600.0, 0)::INT + dj) % 64) + 64) % 64 AS jj
  FROM chosen c, (SELECT a.d AS di, b.d AS dj FROM (SELECT unnest(range(-{_HALF}, {_GEO.half + 1})) AS d) a, (SELECT unnest(range(-{_HALF}, {_GEO.half + 1})) AS d) b)) x LEFT JOIN field f ON f.i = ii AND f.j = jj)"""
_BINS = [0.5, 1.7, 2.9, 4.1, 5.3]


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return stack.pixels(grid.field(_p(spark, d), "gas", H, unit=1.0), _chosen(spark, d), H.n, H.box, _GEO.half, _GEO.step)


query("dsigma_running_stack", s.q(s.massive(TARGET, UPPER), s.field("gas"), _PIXELS, f"""d AS (SELECT object_id, r, avg(value) OVER (PARTITION BY object_id ORDER BY r, tie ROWS UNBOUNDED PRECEDING) - value AS d FROM cut),
b AS (SELECT *, {' + '.join(f'(r >= {e!r}::DOUBLE)::INT' for e in _BINS)} - 1 AS bin FROM d) SELECT object_id, bin::INT AS bin, round(avg(d), 6) AS value, count(*)::BIGINT AS n FROM b WHERE bin >= 0 AND bin < {len(_BINS) - 1} GROUP BY ALL"""))(lambda sp, d: _round(filters.running_excess(_cut(sp, d), _BINS), "value"))
query("dsigma_ring", s.q(s.massive(TARGET, UPPER), s.field("gas"), _PIXELS, """core AS (SELECT * FROM cut WHERE r < 2.05), border AS (SELECT DISTINCT c.object_id, c.di, c.dj, c.value FROM cut c JOIN core k ON c.object_id = k.object_id AND greatest(abs(c.di - k.di), abs(c.dj - k.dj)) = 1 WHERE c.r >= 2.05)
SELECT a.object_id, round(core, 6) AS core, round(border, 6) AS border, round(core - border, 6) AS value FROM (SELECT object_id, avg(value) AS core FROM core GROUP BY 1) a JOIN (SELECT object_id, avg(value) AS border FROM border GROUP BY 1) b ON a.object_id = b.object_id"""))(lambda sp, d: _round(filters.core_minus_border(_cut(sp, d), 2.05), "core", "border", "value"))
query("area_averaged_cap", _stack_sql("CAP", "SELECT radius, round(avg(value) / (pi() * radius * radius), 6) AS mean FROM profile GROUP BY radius"))(lambda sp, d: stats.mean_profile(_stack(sp, d, "CAP")).select("radius", F.round(F.col("mean") / (F.pi() * F.col("radius") * F.col("radius")), 6).alias("mean")))

# ---------------------------------------------------------------- statistics

_TWO = {"ptypes": ["gas", "total"], "all": ["gas", "Stars", "BH", "DM"]}


def _many(spark: SparkSession, d: str, ptypes: list[str], filter_type: str = "cumulative", objects: DataFrame | None = None, key: str = "group_id", f: DataFrame | None = None) -> DataFrame:
    """One stack of several types: a column each."""
    f = grid.fields(_p(spark, d), ptypes, H, unit=1.0) if f is None else f
    return stack.profiles(f, _chosen(spark, d) if objects is None else objects, H.n, H.box, filter_type, RADII, UNIT, key=key, values=tuple(ptypes))


def _many_sql(final: str, types: list[str], more: tuple = (), objects: str = "chosen", key: str = "group_id") -> str:
    parts = []
    for t in types:
        parts += [s.field(t, f"f_{t}"), s.profile(objects, key, name=f"p_{t}", source=f"f_{t}")]
    return s.q(*more, s.massive(TARGET, UPPER), s.stencil("cumulative", RADII, _PER), s.filter_weights("cumulative"), *parts, *[f"m_{t} AS (SELECT radius, avg(value) AS m, stddev_pop(value) / sqrt(count(value)) AS e FROM p_{t} GROUP BY radius)" for t in types], final)


def _means(df: DataFrame, ptype: str) -> DataFrame:
    return stats.mean_profile(df, ptype)


_REL = "power(a.e / nullif(a.m, 0), 2) + power(b.e / nullif(b.m, 0), 2)"
query("ratio_profile", _many_sql(f"SELECT radius, round(a.m / nullif(b.m, 0) / {F_B!r}::DOUBLE, 6) AS ratio, round(abs(a.m / nullif(b.m, 0) / {F_B!r}::DOUBLE) * sqrt({_REL}), 6) AS err FROM m_gas a JOIN m_total b USING (radius)", ["gas", "total"]))(
    lambda sp, d: (lambda t: _round(stats.ratio(_means(t, "gas"), _means(t, "total"), F_B), "ratio", "err"))(_many(sp, d, _TWO["ptypes"]))
)

def _double_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Two samples over the same fields, which are made once."""
    f = stored(grid.fields(_p(spark, d), _TWO["ptypes"], H, unit=1.0))
    both = [_many(spark, d, _TWO["ptypes"], objects=_sham(spark, d), key="subhalo_id", f=f), _many(spark, d, _TWO["ptypes"], f=f)]
    return _round(stats.double_ratio(*[_means(p, t) for p in both for t in ("gas", "total")]), "ratio", "err")


query("fgas_double_ratio", s.q(_SHAM, s.massive(TARGET, UPPER), s.stencil("cumulative", RADII, _PER), s.filter_weights("cumulative"), s.field("gas", "f_gas"), s.field("total", "f_total"), s.profile("sham", "subhalo_id", name="pa", source="f_gas"), s.profile("sham", "subhalo_id", name="pb", source="f_total"), s.profile(name="pc", source="f_gas"), s.profile(name="pd", source="f_total"), *[f"m{x} AS (SELECT radius, avg(value) AS m, stddev_pop(value) / sqrt(count(value)) AS e FROM p{x} GROUP BY radius)" for x in "abcd"], "SELECT radius, round((a.m / nullif(b.m, 0)) / nullif(c.m / nullif(d.m, 0), 0), 6) AS ratio, round(abs((a.m / nullif(b.m, 0)) / nullif(c.m / nullif(d.m, 0), 0)) * sqrt(power(a.e / nullif(a.m, 0), 2) + power(b.e / nullif(b.m, 0), 2) + power(c.e / nullif(c.m, 0), 2) + power(d.e / nullif(d.m, 0), 2)), 6) AS err FROM ma a JOIN mb b USING (radius) JOIN mc c USING (radius) JOIN md d USING (radius)"))(
    lambda sp, d: _double_ratio(sp, d)
)
query("per_halo_ratio", _many_sql(f"SELECT radius, round(avg(a.value / nullif(b.value, 0) / {F_B!r}::DOUBLE), 6) AS mean FROM p_gas a JOIN p_total b USING (object_id, radius) GROUP BY radius", ["gas", "total"]))(
    lambda sp, d: _many(sp, d, _TWO["ptypes"]).groupBy("radius").agg(F.round(F.avg(F.try_divide(F.col("gas"), F.col("total")) / F.lit(F_B)), 6).alias("mean"))
)
query("median_quartiles", _stack_sql("CAP", "SELECT radius, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM profile GROUP BY radius"))(lambda sp, d: _round(stats.quartiles(_stack(sp, d, "CAP")), "q25", "median", "q75"))
query("composition_fractions", _many_sql("SELECT radius, ptype, round(m / nullif(sum(m) OVER (PARTITION BY radius), 0), 6) AS fraction FROM (" + " UNION ALL ".join(f"SELECT radius, '{t}' AS ptype, m FROM m_{t}" for t in _TWO["all"]) + ")", _TWO["all"]))(
    lambda sp, d: _round(stats.composition(_many(sp, d, _TWO["all"]).unpivot(["group_id", "radius"], _TWO["all"], "ptype", "value").groupBy("radius", "ptype").agg(F.avg("value").alias("mean"))), "fraction")
)


def _by_sim(spark: SparkSession, d: str) -> DataFrame:
    """Five samples that stand for simulations, by group id, with a profile with and one without a beam."""
    p = _stack(spark, d, "cumulative").withColumn("sim", F.col("group_id") % 5)
    return p.select("sim", "radius", F.col("value").alias("bare"), (F.col("value") / (F.lit(1.0) + F.col("radius") * (F.col("sim") + 1) / 50)).alias("beamed"))


_SIMS = "sims AS (SELECT object_id % 5 AS sim, radius, value AS bare, value / (1.0 + radius * (object_id % 5 + 1) / 50) AS beamed FROM profile), r AS (SELECT sim, radius, avg(beamed) / nullif(avg(bare), 0) AS r FROM sims GROUP BY ALL)"
_cum = lambda final: s.q(s.massive(TARGET, UPPER), s.field("gas"), s.stencil("cumulative", RADII, _PER), s.filter_weights("cumulative"), s.profile(), _SIMS, final)
query("beam_factor", _cum("SELECT radius, round(avg(r), 6) AS factor, round(stddev_samp(r), 6) AS scatter, count(r)::BIGINT AS n FROM r GROUP BY radius"))(lambda sp, d: _round(stats.beam_factor(_by_sim(sp, d)), "factor", "scatter"))


def _cov(spark: SparkSession, d: str) -> DataFrame:
    return stats.covariance(_by_sim(spark, d).groupBy("sim", "radius").agg(F.avg("bare").alias("value")))


_COV = "m AS (SELECT sim, radius, avg(bare) AS v FROM sims GROUP BY ALL), cov AS (SELECT a.radius AS i, b.radius AS j, covar_samp(a.v, b.v) AS cov FROM m a JOIN m b ON a.sim = b.sim GROUP BY ALL)"
query("covariance", _cum(f"SELECT i, j, round(cov, 5) AS cov FROM (WITH {_COV} SELECT * FROM cov)"))(lambda sp, d: _round(_cov(sp, d), "cov", digits=5))
query("covariance_compensated", _cum(f"SELECT i, j, round(cov / nullif(x.f * y.f, 0), 4) AS cov FROM (WITH {_COV} SELECT * FROM cov) JOIN (SELECT radius AS i, avg(r) AS f FROM r GROUP BY 1) x USING (i) JOIN (SELECT radius AS j, avg(r) AS f FROM r GROUP BY 1) y USING (j)"))(lambda sp, d: _round(stats.compensate(_cov(sp, d), stats.beam_factor(_by_sim(sp, d))), "cov", digits=4))
query("hartlap", _cum(f"SELECT i, j, round(cov / (93.0::DOUBLE / 99.0::DOUBLE), 5) AS cov FROM (WITH {_COV} SELECT * FROM cov)"))(lambda sp, d: _round(stats.apply_hartlap(_cov(sp, d), 100, 5), "cov", digits=5))


#: Samples that stand for simulations, more than there are bins.
SAMPLES = 16


@query("detection_snr")
def _snr(spark: SparkSession, d: str) -> DataFrame:
    """Significance of the mean profile, with the covariance of sixteen samples' means corrected for their number."""
    p = _stack(spark, d, "cumulative").withColumn("sim", F.col("group_id") % SAMPLES)
    means = p.groupBy("sim", "radius").agg(F.avg("value").alias("value"))
    n = means.select("sim").distinct().count()
    names, cov = stats.matrix(stats.apply_hartlap(stats.covariance(means), n, len(RADII)))
    mean = {r["radius"]: r["mean"] for r in stats.mean_profile(means).collect()}
    data = [mean[x] for x in names]
    test = stats.null_test(data, cov)
    return spark.createDataFrame([(stats.detection_snr(data, cov), test["chi2"], test["dof"], test["pte"])], "snr double, chi2 double, dof long, pte double")


# ---------------------------------------------------------------- maps, edges, spectra

_COSMO = Flat(H.h, H.omega_m, H.omega_b)
_MAP_N, _MAP_PIXEL = map_pixels(H.box, H.z, 4.0, _COSMO)
_BEAM = beam.fourier_kernel(32, 6400.0, 3200.0)


def _beam_sql(final: str) -> str:
    step = lambda a, b, src, out: f"{out} AS (SELECT (({a} + d) % 32)::INT AS {a}, {b}, sum(value * w) AS value FROM {src}, kern GROUP BY ({a} + d) % 32, {b})"
    return s.q(s.field("gas", n=32), s.beam_kernel(32, 6400.0, 3200.0), step("i", "j", "field", "half"), step("j", "i", "half", "map"), final)


query("map_beam", _beam_sql("SELECT i, j, round(value, 6) AS value FROM map"))(lambda sp, d: _round(beam.convolve(grid.field(_p(sp, d), "gas", H, 32, unit=1.0), _BEAM), "value"))
query("map_beam_tiles", _beam_sql("SELECT i, j, round(value, 6) AS value FROM map"))(lambda sp, d: _round(tiles.cells(tiles.smoothed(tiles.filled(grid.field(_p(sp, d), "gas", H, 32, unit=1.0), (32, 32)), _BEAM)), "value"))
_UK = k.T_CMB * 1e6 * k.V_OVER_C * 0.5**2
query("map_tau_uk_stack", s.q(s.massive(TARGET, UPPER), s.field("gas", value=_SZ["tau"][0]), s.stencil("CAP", RADII, _PER), s.filter_weights("CAP"), s.profile(), f"SELECT radius, round(avg(value) * {_UK!r}::DOUBLE, 6) AS mean FROM profile GROUP BY radius"))(
    lambda sp, d: stats.mean_profile(stack.profiles(grid.field(_p(sp, d), "tau", H), _chosen(sp, d), H.n, H.box, "CAP", RADII, UNIT)).select("radius", F.round(physics.tau_to_microkelvin(F.col("mean"), 0.5), 6).alias("mean"))
)


_ANGLES = np.linspace(4.2, 16.2, 4)


def _angular(spark: SparkSession, d: str) -> DataFrame:
    """A beamed angular map at its own pixel count, stacked in arcminutes."""
    f = grid.field(_p(spark, d), "tau", H, _MAP_N)
    m = beam.beamed_map(f, _MAP_N, 6.0, _MAP_PIXEL)
    arcmin = H.box / (_MAP_N * _MAP_PIXEL)  # length of one arcminute
    got = stack.profiles(m, _chosen(spark, d), _MAP_N, H.box, "CAP", _ANGLES, arcmin)
    return _round(stats.mean_profile(got).withColumns({c: physics.tau_to_microkelvin(F.col(c), 4.0) for c in ("mean", "err")}), "mean", "err")


_TAU_N = _SZ["tau"][0].replace(repr((k.KPC_CM / H.h) ** 3 / physics.pixel_area_cm2(H.box, H.n, H.h, H.a)), repr((k.KPC_CM / H.h) ** 3 / physics.pixel_area_cm2(H.box, _MAP_N, H.h, H.a)))
_SKY = (s.comoving(H.h, H.omega_m, H.z), f"sky AS (SELECT degrees({H.box!r}::DOUBLE / {H.h!r}::DOUBLE / 1000 / mpc) * 60 AS theta FROM distance)")
_WINDOW = f"kern AS (SELECT d, sum(cos(2 * pi() * m * d / {_MAP_N}) * exp(-0.5 * 36 * power(2 * pi() * least(m, {_MAP_N} - m) / theta, 2) / (8 * ln(2)))) / {_MAP_N} AS w FROM sky, (SELECT unnest(range({_MAP_N})) AS m), (SELECT unnest(range({_MAP_N})) AS d) GROUP BY d)"
_BEAMED = [f"{out} AS (SELECT (({a} + d) % {_MAP_N})::INT AS {a}, {b}, sum(value * w) AS value FROM {src}, kern GROUP BY ({a} + d) % {_MAP_N}, {b})" for a, b, src, out in (("i", "j", "field", "half"), ("j", "i", "half", "map"))]
_MEAN_UK = f"SELECT radius, round(avg(value) * {k.T_CMB * 1e6 * k.V_OVER_C * 4.0**2!r}::DOUBLE, 6) AS mean, round(stddev_pop(value) / sqrt(count(value)) * {k.T_CMB * 1e6 * k.V_OVER_C * 4.0**2!r}::DOUBLE, 6) AS err, count(value)::BIGINT AS n FROM profile GROUP BY radius"
query("map_angular_stack", s.q(s.massive(TARGET, UPPER), *_SKY, s.field("gas", value=_TAU_N, n=_MAP_N), _WINDOW, *_BEAMED, s.stencil("CAP", _ANGLES, f"({_MAP_N} / (SELECT theta FROM sky))"), s.filter_weights("CAP"), s.profile(source="map", n=_MAP_N, cell=H.box / _MAP_N), _MEAN_UK))(_angular)


def _simulation(spark: SparkSession, d: str) -> Simulation:
    return Simulation(_p(spark, d), _h(spark, d), _sub(spark, d), H)


def _excess_map(spark: SparkSession, d: str, way: str | None = None) -> DataFrame:
    """Excess surface density of an angular map of all matter, in arcminutes: a ring of 0.75, over a true pixel's area."""
    got = _simulation(spark, d).stack_map("total", "DSigma", _ANGLES, pixel=4.0, beam_arcmin=None, load=False, way=way, mean_mass=TARGET, upper=UPPER)
    return _round(stats.mean_profile(got.withColumn("value", F.col("value") / F.lit(1e10))), "mean", "err")


_TOTAL_N = f"field AS (SELECT {s.bin_of('x', _MAP_N)} AS i, {s.bin_of('y', _MAP_N)} AS j, sum(mass) AS value FROM particles WHERE ptype IN {s.TYPES['total']} GROUP BY ALL)"
_RING = "((w.w) / (SELECT power(theta / " + str(_MAP_N) + ", 2) FROM sky))"
_EXCESS_SQL = s.q(s.massive(TARGET, UPPER), *_SKY, _TOTAL_N, s.stencil("DSigma", _ANGLES, f"({_MAP_N} / (SELECT theta FROM sky))"), s.filter_weights("DSigma", 0.75), s.profile(n=_MAP_N, cell=H.box / _MAP_N).replace("w.w,", f"{_RING} AS w,"), s.MEAN_SE)
query("dsigma_map_stack", _EXCESS_SQL)(_excess_map)
query("dsigma_map_stack_by_maps", _EXCESS_SQL)(lambda sp, d: _excess_map(sp, d, "maps"))

_RUN_RADII = np.linspace(4.2, 20.2, 5)
_RUN_EDGES, _RUN_PIXEL = physics.running_bins(_RUN_RADII, H.z, 4.0, _COSMO)


def _running_map(spark: SparkSession, d: str) -> DataFrame:
    """The running excess by the same entry as the other filters."""
    got = _simulation(spark, d).stack_map("total", "DSigma_mccarthy", _RUN_RADII, pixel=4.0, beam_arcmin=None, load=False, mean_mass=TARGET, upper=UPPER)
    return _round(stats.mean_profile(got.withColumn("value", F.col("value"))), "mean", "err")


_ORDERED = f"(di + (SELECT half FROM square)) * (2 * (SELECT half FROM square) + 1) + dj + (SELECT half FROM square)"
query("dsigma_running_map_stack", s.q(s.massive(TARGET, UPPER), *_SKY, _TOTAL_N, s.stencil("DSigma_mccarthy", _RUN_RADII, f"({_MAP_N} / (SELECT theta FROM sky))"), f"""cut AS (SELECT group_id AS object_id, r, tie, coalesce(value, 0.0) * 1e10::DOUBLE / {_RUN_PIXEL**2!r}::DOUBLE AS value FROM (
  SELECT c.group_id, r, {_ORDERED} AS tie, (((round_even(pos_x / {H.box / _MAP_N!r}::DOUBLE, 0)::INT + di) % {_MAP_N}) + {_MAP_N}) % {_MAP_N} AS ii, (((round_even(pos_y / {H.box / _MAP_N!r}::DOUBLE, 0)::INT + dj) % {_MAP_N}) + {_MAP_N}) % {_MAP_N} AS jj FROM chosen c, pixel) x LEFT JOIN field f ON f.i = ii AND f.j = jj)""",
    "d AS (SELECT object_id, r, avg(value) OVER (PARTITION BY object_id ORDER BY r, tie ROWS UNBOUNDED PRECEDING) - value AS d FROM cut)",
    f"profile AS (SELECT object_id, radius, avg(d) AS value FROM d, (VALUES {', '.join(f'({r!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE)' for r, a, b in zip(map(float, _RUN_RADII), map(float, _RUN_EDGES[:-1]), map(float, _RUN_EDGES[1:]), strict=True))}) b(radius, lo, hi) WHERE r >= lo AND r < hi GROUP BY ALL)", s.MEAN_SE))(_running_map)



def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Bins whose geometric means are from one to six mean radii of halos, in Mpc/h."""
    unit = _h(spark, d).agg(F.avg("group_rad")).first()[0] / 1e3
    edges, _ = physics.geometric_edges(np.linspace(1, 6, 9) * unit, 0.74 * unit)
    return spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(edges)], "i int, edge double")


query("geomean_bins", s.q("unit AS (SELECT avg(group_rad) / 1e3 AS u FROM halos)", "b AS (SELECT 0 AS i, 0.74::DOUBLE * u AS edge FROM unit UNION ALL SELECT i + 1, power((1 + 0.625 * i) * u, 2) / edge FROM b, unit WHERE i < 9)", "SELECT i, round(edge, 9) AS edge FROM b"))(_edges)
query("min_image_distance", s.q("SELECT group_id, CASE WHEN pos_x - 100000.0 >= 51200.0 THEN pos_x - 100000.0 - 102400.0 WHEN pos_x - 100000.0 < -51200.0 THEN pos_x - 100000.0 + 102400.0 ELSE pos_x - 100000.0 END AS dx FROM halos"))(lambda sp, d: _h(sp, d).select("group_id", physics.minimum_image(F.col("pos_x") - F.lit(100000.0), H.box).alias("dx")))
query("sci_labels", s.q("SELECT group_id, regexp_replace(split_part(format('{:.2e}', group_rad), 'e', 1), '\\.?0+$', '') || 'e' || split_part(format('{:.2e}', group_rad), 'e', 2)::INT::VARCHAR AS label FROM halos"))(lambda sp, d: _h(sp, d).select("group_id", physics.sci(F.col("group_rad")).alias("label")))
query("ksz_from_delta_sigma", s.q(f"SELECT group_id, round(group_rad * 1e-3 * {-k.T_CMB * 300.0 * 1e3 / 299792458.0 * (0.04897 / 0.30966 * 6.6524587321e-29 / (k.MU_E_KSZ * 1.67262192369e-27)) * 1e6!r}::DOUBLE * 1e6, 6) AS dt FROM halos"))(lambda sp, d: _h(sp, d).select("group_id", F.round(physics.ksz_from_delta_sigma(F.col("group_rad") * F.lit(1e-3), 0.5)["dT_muK"] * F.lit(1e6), 6).alias("dt")))

_PK_N, _PK_BOX = 16, H.box / 1e3


def _modes(spark: SparkSession, d: str, ptype: str) -> tiles.Tiles:
    """The half spectrum of a type's overdensity, kept for the spectra that read it."""
    g = grid.tsc_grid(grid.of_type(_p(spark, d), ptype), F.col("mass"), H.box, _PK_N)
    return tiles.kept(tiles.transform(tiles.overdensity(tiles.kept(tiles.filled(g, (_PK_N,) * 3)))))


def _modes_sql(ptype: str) -> str:
    """The same, as t_<ptype>, by plain sums."""
    rows = _tsc_sql("xyz", _PK_N, ptype)
    body = rows[rows.index("own AS (") :].rstrip()
    parts, final = body.rsplit("SELECT cx AS i", 1)
    for name in ("own", "tx", "ty", "tz"):
        parts = parts.replace(f"{name} AS (", f"{name}_{ptype} AS (").replace(f"FROM {name} p", f"FROM {name}_{ptype} p")
    final = "SELECT cx AS i" + final.replace("round(sum(mass * wx * wy * wz), 6)", "sum(mass * wx * wy * wz)").replace("FROM tz", f"FROM tz_{ptype}")
    mean = f"SELECT i, j, k, value / (SELECT sum(value) / {_PK_N**3} FROM g_{ptype}) AS re, 0.0::DOUBLE AS im FROM g_{ptype}"
    return f"{parts.rstrip().rstrip(',')},\ng_{ptype} AS ({final}),\nf_{ptype} AS ({mean}),\n{s.dft(f'f_{ptype}', f't_{ptype}', _PK_N)}"


_PK_EDGES = [0.05, 0.15, 0.3, 0.6]
query("pk_3d", s.q(_modes_sql("total"), s.power("t_total", "t_total", "pk", _PK_N, _PK_BOX), "SELECT bin, round(k, 9) AS k, round(p, 6) AS p, n_modes FROM pk"))(lambda sp, d: _round(_round(tiles.power(_modes(sp, d, "total"), None, _PK_BOX), "k", digits=9), "p"))
query("pk_suppression", s.q(_modes_sql("total"), _modes_sql("DM"), s.power("t_total", "t_total", "pt", _PK_N, _PK_BOX), s.power("t_DM", "t_DM", "pd", _PK_N, _PK_BOX), "SELECT bin, round(pt.k, 9) AS k, round(pt.p, 6) AS p_total, round(pd.p, 6) AS p_dm, round(pt.p / nullif(pd.p, 0), 6) AS suppression FROM pt JOIN pd USING (bin)"))(
    lambda sp, d: _round(_round(spectra.suppression(*(tiles.power(_modes(sp, d, t), None, _PK_BOX) for t in ("total", "DM"))), "k", digits=9), "p_total", "p_dm", "suppression")
)


def _cross(spark: SparkSession, d: str) -> DataFrame:
    a, b = _modes(spark, d, "gas"), _modes(spark, d, "DM")
    p = [tiles.power(x, y, _PK_BOX, _PK_EDGES) for x, y in ((a, b), (a, None), (b, None))]
    return _round(spectra.cross_correlation(*p), "k", "r")


query("cross_corr_coeff", s.q(_modes_sql("gas"), _modes_sql("DM"), *[s.power(f"t_{x}", f"t_{y}", f"p{x}{y}", _PK_N, _PK_BOX, edges=_PK_EDGES) for x, y in (("gas", "DM"), ("gas", "gas"), ("DM", "DM"))], "SELECT bin, round(pgasDM.k, 6) AS k, round(pgasDM.p / sqrt(pgasgas.p * pDMDM.p), 6) AS r FROM pgasDM JOIN pgasgas USING (bin) JOIN pDMDM USING (bin)"))(_cross)
_LAG = " + ".join(f"{s.wave(x, _PK_N)} * {s.wave(x, _PK_N)}" for x in "ijk")
query("correlation_3d", s.q(_modes_sql("DM"), f"sq AS (SELECT i, j, k, CASE WHEN i + j + k = 0 THEN 0.0 ELSE (re * re + im * im) / {_PK_N**3} END AS re, 0.0::DOUBLE AS im FROM t_DM)", s.dft("sq", "back", _PK_N, 1), f"SELECT bin, round(avg(r) * {_PK_BOX / _PK_N!r}::DOUBLE, 6) AS r, round(avg(xi), 6) AS xi FROM (SELECT round_even(r, 0)::INT AS bin, r, xi FROM (SELECT sqrt(({_LAG})::DOUBLE) AS r, re / {_PK_N**3} AS xi FROM back)) GROUP BY bin"))(
    lambda sp, d: _round(tiles.correlation(_modes(sp, d, "DM"), None, _PK_BOX), "r", "xi")
)


def _cells(spark: SparkSession, d: str, ptype: str) -> DataFrame:
    """A type's spectrum in the cells of the full transform, for filters that mix its axes."""
    g = stored(grid.tsc_grid(grid.of_type(_p(spark, d), ptype), F.col("mass"), H.box, _PK_N))  # read for its mean and its cells
    mean = g.agg((F.sum("value") / F.lit(float(_PK_N**3))).alias("m"))
    return spectra.fft(g.crossJoin(mean).select("i", "j", "k", (F.col("value") / F.col("m")).alias("value")), _PK_N)


query("bias_fields")(lambda sp, d: spectra.bias_fields(spectra.gaussian_filter(_cells(sp, d, "DM"), _PK_N, H.box / 1e3, 0.4), _PK_N, H.box / 1e3))
