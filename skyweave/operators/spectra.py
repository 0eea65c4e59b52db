"""Power spectra of periodic fields: a Fourier transform by slabs and blocks of lines, then bins of k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

_AXES = ("i", "j", "k")
#: Cells that one task transforms at a time.
GROUP_CELLS = 1 << 18


def _slab(first: str, rest: list[str], n: int, thick: int, inverse: bool):
    """Transform the planes of a slab along all axes but the first."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        low = int(p["slab"].iloc[0]) * thick
        planes = min(thick, n - low)
        a = np.zeros((planes, *[n] * len(rest)), complex)
        a[tuple([p[first].to_numpy() - low, *[p[x].to_numpy() for x in rest]])] = p["re"].to_numpy() + 1j * p["im"].to_numpy()
        axes = tuple(range(1, a.ndim))
        a = (np.fft.ifftn if inverse else np.fft.fftn)(a, axes=axes)
        at = np.indices(a.shape, np.int32).reshape(a.ndim, -1)
        return pd.DataFrame({first: at[0] + np.int32(low), **dict(zip(rest, at[1:], strict=True)), "re": a.real.ravel(), "im": a.imag.ravel()})

    return run


def _columns(first: str, rest: list[str], n: int, many: int, inverse: bool):
    """Transform a block of lines along the first axis."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        low = int(p["block"].iloc[0]) * many
        lines = min(many, n ** len(rest) - low)
        a = np.zeros((n, lines), complex)
        a[p[first].to_numpy(), p["line"].to_numpy() - low] = p["re"].to_numpy() + 1j * p["im"].to_numpy()
        a = (np.fft.ifft if inverse else np.fft.fft)(a, axis=0)
        i, line = np.indices(a.shape).reshape(2, -1)
        places = np.unravel_index(line + low, [n] * len(rest))
        return pd.DataFrame({first: i.astype(np.int32), **{x: at.astype(np.int32) for x, at in zip(rest, places, strict=True)}, "re": a.real.ravel(), "im": a.imag.ravel()})

    return run


def fft(field: DataFrame, n: int, axes: tuple = _AXES, inverse: bool = False) -> DataFrame:
    """(axes, re, im) of a field (axes, value) or (axes, re, im); absent cells are 0.

    The grid is shuffled twice: into slabs of the first axis, whose planes are transformed along the other axes, and
    into blocks of lines along the first. A task holds about GROUP_CELLS cells, or a plane where that is larger.
    """
    if "value" in field.columns:
        field = field.select(*axes, F.col("value").alias("re"), F.lit(0.0).alias("im"))
    first, rest = axes[0], list(axes[1:])
    schema = ", ".join(f"{a} int" for a in axes) + ", re double, im double"
    thick, many = max(1, GROUP_CELLS // n ** len(rest)), max(1, GROUP_CELLS // n)
    slabs = field.select(*axes, "re", "im", F.floor(F.col(first) / thick).alias("slab")).groupBy("slab").applyInPandas(_slab(first, rest, n, thick, inverse), schema)
    line = F.lit(0).cast("long")
    for a in rest:
        line = line * n + F.col(a)
    blocks = slabs.select(*axes, "re", "im", line.alias("line")).withColumn("block", F.floor(F.col("line") / many))
    return blocks.groupBy("block").applyInPandas(_columns(first, rest, n, many, inverse), schema)


def wavenumber(axis: str, n: int, box: float) -> Column:
    return F.when(F.col(axis) * 2 < n, F.col(axis)).otherwise(F.col(axis) - n) * F.lit(2 * np.pi / box)


def k2(n: int, box: float, axes: tuple = _AXES) -> Column:
    return sum((wavenumber(a, n, box) * wavenumber(a, n, box) for a in axes), F.lit(0.0))


def tsc_window(n: int, axes: tuple = _AXES) -> Column:
    """Transform of the triangular-shaped-cloud assignment: sinc cubed along each axis."""
    out = F.lit(1.0)
    for a in axes:
        x = wavenumber(a, n, float(n)) / 2
        s = F.when(F.col(a) == 0, 1.0).otherwise(F.sin(x) / x)
        out = out * s * s * s
    return out


def power(one: DataFrame, two: DataFrame | None, n: int, box: float, edges: list[float] | None = None, mas: bool = True) -> DataFrame:
    """(bin, k, p, n_modes): auto or cross power of transforms, averaged in bins of k.

    Bins of the fundamental mode up to the Nyquist wavenumber unless edges are given; the zero mode is left out.
    """
    a = one.select(*_AXES, F.col("re").alias("r1"), F.col("im").alias("i1"))
    b = a.select(*_AXES, F.col("r1").alias("r2"), F.col("i1").alias("i2")) if two is None else two.select(*_AXES, F.col("re").alias("r2"), F.col("im").alias("i2"))
    rows = a.withColumns({"r2": F.col("r1"), "i2": F.col("i1")}) if two is None else a.join(b, list(_AXES))
    k = F.sqrt(k2(n, box))
    p = (F.col("r1") * F.col("r2") + F.col("i1") * F.col("i2")) * F.lit(box**3 / float(n) ** 6)
    if mas:
        w = tsc_window(n)
        p = p / (w * w)
    if edges is None:
        base = 2 * np.pi / box
        number = F.rint(F.col("k") / F.lit(base)).cast("int")
        keep = (F.col("k") > 0) & (F.col("k") <= np.pi * n / box)
    else:
        number = sum(((F.col("k") >= float(e)).cast("int") for e in edges), F.lit(0)) - 1
        keep = (F.col("k") > 0) & (F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1)
    rows = rows.select(k.alias("k"), p.alias("p")).withColumn("bin", number).where(keep)
    return rows.groupBy("bin").agg(F.avg("k").alias("k"), F.avg("p").alias("p"), F.count("*").alias("n_modes"))


def correlation(one: DataFrame, two: DataFrame | None, n: int, box: float) -> DataFrame:
    """(bin, r, xi): the inverse transform of the power, averaged in shells of a cell's width."""
    b = one if two is None else two
    prod = one.select(*_AXES, F.col("re").alias("r1"), F.col("im").alias("i1")).join(b.select(*_AXES, F.col("re").alias("r2"), F.col("im").alias("i2")), list(_AXES))
    power_ = prod.select(*_AXES, ((F.col("r1") * F.col("r2") + F.col("i1") * F.col("i2")) / float(n) ** 3).alias("re"), ((F.col("i1") * F.col("r2") - F.col("r1") * F.col("i2")) / float(n) ** 3).alias("im"))
    d = [F.when(F.col(a) * 2 < n, F.col(a)).otherwise(F.col(a) - n) for a in _AXES]
    r = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    rows = fft(power_, n, inverse=True).select(r.alias("r"), F.col("re").alias("xi"))
    return rows.groupBy(F.rint("r").cast("int").alias("bin")).agg((F.avg("r") * F.lit(box / n)).alias("r"), F.avg("xi").alias("xi"))


def cross_correlation(p_x: DataFrame, p_1: DataFrame, p_2: DataFrame) -> DataFrame:
    """P_x / sqrt(P_1 P_2) by bin."""
    named = [p.select("bin", "k" if i == 0 else F.lit(0).alias(f"_{i}"), F.col("p").alias(f"p{i}")) for i, p in enumerate((p_x, p_1, p_2))]
    return named[0].join(named[1], "bin").join(named[2], "bin").select("bin", "k", F.try_divide(F.col("p0"), F.sqrt(F.col("p1") * F.col("p2"))).alias("r"))


def suppression(p_total: DataFrame, p_dm: DataFrame) -> DataFrame:
    t = p_total.select("bin", "k", F.col("p").alias("p_total"))
    return t.join(p_dm.select("bin", F.col("p").alias("p_dm")), "bin").select("bin", "k", "p_total", "p_dm", F.try_divide(F.col("p_total"), F.col("p_dm")).alias("suppression"))


def gaussian_filter(modes: DataFrame, n: int, box: float, k_cut: float) -> DataFrame:
    f = F.exp(-k2(n, box) / F.lit(2 * k_cut**2))
    return modes.select(*_AXES, (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im"))


def laplacian(modes: DataFrame, n: int, box: float) -> DataFrame:
    f = -k2(n, box)
    return modes.select(*_AXES, (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im"))


def tidal(modes: DataFrame, n: int, box: float, a: str, b: str) -> DataFrame:
    """One component of the tidal tensor: (k_a k_b / k^2 - delta_ab / 3) times the modes."""
    q = k2(n, box)
    f = F.when(q > 0, wavenumber(a, n, box) * wavenumber(b, n, box) / q).otherwise(0.0) - F.when(q > 0, 1 / 3 if a == b else 0.0).otherwise(0.0)
    return modes.select(*_AXES, (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im"))


def _real(modes: DataFrame, n: int, name: str) -> DataFrame:
    return fft(modes, n, inverse=True).select(*_AXES, F.col("re").alias(name))


def tidal_squared(modes: DataFrame, n: int, box: float) -> DataFrame:
    """(i, j, k, s2): sum of squares of the tidal tensor, off-diagonal components twice."""
    total = None
    for x in range(3):
        for y in range(x, 3):
            part = _real(tidal(modes, n, box, _AXES[x], _AXES[y]), n, "s").select(*_AXES, (F.col("s") * F.col("s") * (1.0 if x == y else 2.0)).alias("s2"))
            total = part if total is None else total.unionByName(part)
    return total.groupBy(*_AXES).agg(F.sum("s2").alias("s2"))


def bias_fields(modes: DataFrame, n: int, box: float) -> DataFrame:
    """(i, j, k, delta, delta2, s2, nabla2): the first three less their means."""
    modes = stored(modes)  # eight inverse transforms read them
    d = _real(modes, n, "delta").withColumn("delta2", F.col("delta") * F.col("delta"))
    rows = d.join(tidal_squared(modes, n, box), list(_AXES)).join(_real(laplacian(modes, n, box), n, "nabla2"), list(_AXES))
    means = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in ("delta", "delta2", "s2")])
    return rows.crossJoin(means).select(*_AXES, *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in ("delta", "delta2", "s2")], "nabla2")
