"""SQL over the same tables: views as common table expressions, and text for stencils."""

from __future__ import annotations

import numpy as np

BASE = """
particles AS (SELECT l_orderkey * 10 + l_linenumber AS particle_id,
  CASE WHEN l_returnflag = 'A' THEN 'gas' WHEN l_returnflag = 'N' THEN 'DM' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Stars' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'BH' END AS ptype,
  ((l_orderkey * 7919 + l_linenumber * 7717) % 102400)::DOUBLE AS x, ((l_partkey * 7723 + l_linenumber * 6311 + l_orderkey * 31) % 102400)::DOUBLE AS y,
  ((l_suppkey * 9973 + l_orderkey * 17 + l_partkey * 13) % 102400)::DOUBLE AS z, l_quantity AS mass, 1.0::DOUBLE + l_discount AS electron_abundance,
  l_extendedprice AS internal_energy, 1.0::DOUBLE + 100.0::DOUBLE * l_tax AS density, (l_discount - 0.05::DOUBLE) * 2000.0::DOUBLE AS vz FROM lineitem),
halos AS (SELECT c_custkey AS group_id, ((c_custkey * 104729) % 102400)::DOUBLE AS pos_x, ((c_custkey * 7907 + 13) % 102400)::DOUBLE AS pos_y, ((c_custkey * 6421 + 29) % 102400)::DOUBLE AS pos_z,
  round_even((c_acctbal + 1000.0) * 100.0, 0) * 1e8 AS group_mass, (400 + c_custkey % 17 * 100)::DOUBLE AS group_rad FROM customer),
subhalos AS (SELECT o_orderkey AS subhalo_id, o_custkey AS parent_group_id,
  fmod(pos_x + (o_orderkey % 401 - 200)::DOUBLE + 102400, 102400) AS pos_x, fmod(pos_y + (o_orderkey % 401 - 200)::DOUBLE + 102400, 102400) AS pos_y, fmod(pos_z + (o_orderkey % 401 - 200)::DOUBLE + 102400, 102400) AS pos_z,
  o_totalprice * 1e6 AS subhalo_mstar, o_totalprice * 1e8 AS subhalo_mass FROM orders JOIN halos ON o_custkey = group_id)"""

AXES = {"xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}
TYPES = {"total": "('gas', 'DM', 'Stars', 'BH')", "baryon": "('gas', 'Stars', 'BH')"}


def q(*parts: str) -> str:
    """WITH the base views and more, and a final SELECT."""
    return f"WITH RECURSIVE {BASE}" + "".join(f",\n{p}" for p in parts[:-1]) + ("\n" if parts[-1].startswith("SELECT") else ",\n") + parts[-1]


def bin_of(x: str, n: int = 64, box: int = 102400) -> str:
    return f"least(floor({x} * {n} / {box}.0::DOUBLE), {n - 1})::INT"


def field(ptype: str, name: str = "field", projection: str = "xy", value: str = "mass", n: int = 64) -> str:
    a, b = AXES[projection]
    types = TYPES.get(ptype, f"('{ptype}')")
    return f"{name} AS (SELECT {bin_of(a, n)} AS i, {bin_of(b, n)} AS j, sum({value}) AS value FROM particles WHERE ptype IN {types} GROUP BY ALL)"


def massive(target: float, upper: float, name: str = "chosen") -> str:
    return f"{name} AS (SELECT * EXCLUDE (m) FROM (SELECT *, avg(group_mass) OVER (ORDER BY group_mass DESC, group_id ROWS UNBOUNDED PRECEDING) AS m FROM halos WHERE group_mass <= {upper}) WHERE m > {target})"


def numbers(values) -> str:
    return ", ".join(f"({float(v)!r}::DOUBLE)" for v in values)


def stencil(filter_type: str, radii: np.ndarray, per_unit: float | str) -> str:
    """pixel (di, dj, r) and radius tables, from the square's reach in radius units and in pixels."""
    reach = f"{'ceil(sqrt(2.0::DOUBLE) * ' if filter_type == 'CAP' else 'floor('}{float(max(radii))!r}::DOUBLE) + 1"
    return f"""square AS (SELECT {reach} AS reach, round_even(({reach}) * {per_unit}::DOUBLE, 0)::INT AS half),
pixel AS (SELECT a.d::INT AS di, b.d::INT AS dj, sqrt((a.d * a.d + b.d * b.d)::DOUBLE) * (reach / half) AS r
  FROM (SELECT unnest(range(-half, half + 1)) AS d FROM square) a, (SELECT unnest(range(-half, half + 1)) AS d FROM square) b, square),
radii AS (SELECT * FROM (VALUES {numbers(radii)}) t(radius))"""


def _share(inside: str) -> str:
    return f"CASE WHEN {inside} THEN 1.0 / sum(({inside})::INT) OVER (PARTITION BY radius) ELSE 0.0 END"


def filter_weights(filter_type: str, dr: float = 0.0, area: float = 1.0) -> str:
    """w (radius, di, dj, w) from pixel and radii, each by the filter's own definition; an excess is over a pixel's area."""
    ring = "r > radius AND r <= sqrt(2.0::DOUBLE) * radius"
    count = lambda c: f"sum(({c})::INT) OVER (PARTITION BY radius)"
    core = {"CAP": "r <= radius", "ringring": "r > 1.0 AND r <= radius"}.get(filter_type, "")
    made = {
        "cumulative": "CASE WHEN r < radius THEN 1.0 ELSE 0.0 END",
        "DSigma": f"({_share('r < radius')} - {_share(f'r >= radius AND r < radius + {dr!r}')}) / {area!r}::DOUBLE",
        "upsilon": f"{_share('r < radius')} - {_share('r >= radius AND r < radius + 0.5')} - power(1.0 / radius, 2) * ({_share('r < 1.0')} - {_share('r >= 1.0 AND r < 1.5')})",
        "DSigma_area": f"CASE WHEN r < radius THEN 1.0 / (pi() * radius * radius) WHEN r < radius + {dr!r} THEN -1.0 / (pi() * (power(radius + {dr!r}, 2) - radius * radius)) ELSE 0.0 END",
    }.get(filter_type) or f"CASE WHEN {core} THEN 1.0 WHEN {ring} THEN -({count(core)})::DOUBLE / {count(ring)} ELSE 0.0 END"
    return f"w AS (SELECT radius, di, dj, {made} AS w FROM pixel, radii)"


def profile(objects: str = "chosen", key: str = "group_id", projection: str = "xy", name: str = "profile", source: str = "field", n: int = 64, cell: float = 1600.0) -> str:
    a, b = AXES[projection]
    return f"""{name} AS (SELECT {key} AS object_id, radius, sum(w * coalesce(value, 0)) AS value FROM (
  SELECT c.{key}, w.radius, w.w, (((round_even(pos_{a} / {cell!r}, 0)::INT + di) % {n}) + {n}) % {n} AS ii, (((round_even(pos_{b} / {cell!r}, 0)::INT + dj) % {n}) + {n}) % {n} AS jj FROM {objects} c, w) s
  LEFT JOIN {source} f ON f.i = ii AND f.j = jj GROUP BY ALL)"""


MEAN_SE = "SELECT radius, round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(value)), 6) AS err, count(value)::BIGINT AS n FROM profile GROUP BY radius"


# ---------------------------------------------------------------- transforms and distances


def dft(source: str, name: str, n: int, sign: int = -1, axes: str = "ijk") -> str:
    """The sums of a transform of (axes, re, im), one axis after the other."""
    parts, last = [], source
    for x in axes:
        rest = [a for a in axes if a != x]
        angle = f"{sign * 2}.0 * pi() * m * {x} / {n}"
        out = name if x == axes[-1] else f"{name}_{x}"
        parts.append(f"{out} AS (SELECT m::INT AS {x}, {', '.join(rest)}, sum(re * cos({angle}) - im * sin({angle})) AS re, sum(re * sin({angle}) + im * cos({angle})) AS im FROM {last}, (SELECT unnest(range({n})) AS m) GROUP BY m, {', '.join(rest)})")
        last = out
    return ",\n".join(parts)


def wave(axis: str, n: int) -> str:
    return f"(CASE WHEN 2 * {axis} < {n} THEN {axis} ELSE {axis} - {n} END)"


def power(one: str, two: str, name: str, n: int, box: float, mas: bool = True, edges: list[float] | None = None) -> str:
    """name (bin, k, p, n_modes) of two transforms."""
    f2 = " + ".join(f"{wave(f'a.{x}', n)} * {wave(f'a.{x}', n)}" for x in "ijk")
    sinc = " * ".join(f"power(CASE WHEN a.{x} = 0 THEN 1.0 ELSE sin(pi() * {wave(f'a.{x}', n)} / {n}) / (pi() * {wave(f'a.{x}', n)} / {n}) END, 3)" for x in "ijk")
    p = f"(a.re * b.re + a.im * b.im) * power({box!r}::DOUBLE, 3) / power({n}, 6)" + (f" / power({sinc}, 2)" if mas else "")
    number = " + ".join(f"(k >= {e!r}::DOUBLE)::INT" for e in edges) + " - 1" if edges else "round_even(f, 0)::INT"
    keep = f"bin BETWEEN 0 AND {len(edges) - 2}" if edges else f"f <= {n / 2!r}"
    return f"""{name} AS (SELECT bin, avg(k) AS k, avg(p) AS p, count(*)::BIGINT AS n_modes FROM (SELECT *, ({number})::INT AS bin FROM (SELECT *, f * 2 * pi() / {box!r}::DOUBLE AS k FROM (
  SELECT sqrt(({f2})::DOUBLE) AS f, {p} AS p FROM {one} a JOIN {two} b ON a.i = b.i AND a.j = b.j AND a.k = b.k))) WHERE f > 0 AND {keep} GROUP BY bin)"""


def comoving(h: float, omega_m: float, z: float, name: str = "distance") -> str:
    """name (mpc): the comoving distance in a flat universe with photons at 2.7255 K and 3.04 massless neutrinos, by Simpson's rule."""
    r = f"(2.472796e-5::DOUBLE / power({h!r}::DOUBLE, 2) * (1 + 0.22710731766::DOUBLE * 3.04::DOUBLE))"
    e = f"sqrt({omega_m!r}::DOUBLE * power(1 + s, 3) + {r} * power(1 + s, 4) + 1 - {omega_m!r}::DOUBLE - {r})"
    return f"{name} AS (SELECT 299792.458::DOUBLE / (100 * {h!r}::DOUBLE) * sum(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / {e}) * {z!r}::DOUBLE / 3000 AS mpc FROM (SELECT i, {z!r}::DOUBLE * i / 1000 AS s FROM (SELECT unnest(range(1001)) AS i)))"


def beam_kernel(n: int, fwhm: float, pixel: float, name: str = "kern") -> str:
    """name (d, w): the inverse transform of a Gaussian beam's window along one axis."""
    window = f"exp(-0.5 * power({fwhm!r}::DOUBLE * 2 * pi() * least(m, {n} - m) / {n} / {pixel!r}::DOUBLE, 2) / (8 * ln(2::DOUBLE)))"
    return f"{name} AS (SELECT d, sum(cos(2 * pi() * m * d / {n}) * {window}) / {n} AS w FROM (SELECT unnest(range({n})) AS m), (SELECT unnest(range({n})) AS d) GROUP BY d)"


def gaussian(n: int, fwhm: float, pixel: float, name: str = "kern") -> str:
    """name (d, w): a Gaussian of sigma = fwhm / 2.355, cut at four sigmas, normalised and wrapped."""
    sigma = f"({fwhm!r}::DOUBLE / (2.355::DOUBLE * {pixel!r}::DOUBLE))"
    return f"""{name} AS (SELECT ((d % {n}) + {n}) % {n} AS d, sum(g / total) AS w FROM (SELECT d, g, sum(g) OVER () AS total FROM (
  SELECT d, exp(-0.5 * power(d / {sigma}, 2)) AS g FROM (SELECT unnest(range(-{n}, {n} + 1)) AS d) WHERE abs(d) <= floor(4 * {sigma} + 0.5))) GROUP BY ((d % {n}) + {n}) % {n})"""
