"""Aperture filters as weight tables over the pixels around an object.

All weights depend on the pixel's distance alone, so a table has a row for each radius and squared offset q.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = ("cumulative", "CAP", "ringring", "DSigma", "upsilon", "DSigma_area", "DSigma_kernel_map", "DSigma_mccarthy")


@dataclass(frozen=True)
class Geometry:
    """The square of pixels around an object: half-width in pixels, and radius units for one pixel."""

    half: int
    step: float

    @classmethod
    def of(cls, name: str, radii: np.ndarray, pixels_per_unit: float) -> Geometry:
        reach = int(np.ceil(np.sqrt(2) * max(radii))) + 1 if name == "CAP" else int(max(radii) + 1)
        half = int(np.round(reach * pixels_per_unit))
        return cls(half, reach / half if half else 0.0)

    def distances(self) -> tuple[np.ndarray, np.ndarray]:
        d = np.arange(-self.half, self.half + 1)
        q = (d[:, None] ** 2 + d[None, :] ** 2).ravel()
        return q, np.sqrt(q) * self.step


def _mean_of(mask: np.ndarray) -> np.ndarray:
    return mask / mask.sum() if mask.any() else np.zeros(len(mask))


def _excess(r: np.ndarray, at: float, dr: float, area: float) -> np.ndarray:
    if dr <= 0:
        raise ValueError("dr must be positive")
    return (_mean_of(r < at) - _mean_of((r >= at) & (r < at + dr))) / area


def _compensated(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    return inner - (inner.sum() / outer.sum() if outer.any() else 0.0) * outer


def weights(name: str | Callable, r: np.ndarray, at: float, pixel: float = 1.0, r0: float = 1.0, dr: float | None = None) -> np.ndarray:
    """Weight of every pixel of one radius; a callable (r, at) -> weights is a filter of the caller's own."""
    if callable(name):
        return name(r, at)
    if name == "cumulative":
        return (r < at).astype(float)
    if name == "CAP":
        return _compensated((r <= at).astype(float), ((r > at) & (r <= np.sqrt(2) * at)).astype(float))
    if name == "ringring":
        return _compensated(((r > r0) & (r <= at)).astype(float), ((r > at) & (r <= np.sqrt(2) * at)).astype(float))
    if name == "DSigma":
        return _excess(r, at, 0.75 if dr is None else dr, pixel**2)
    if name == "upsilon":
        dr = 0.5 if dr is None else dr
        return _excess(r, at, dr, 1.0) - (r0 / at) ** 2 * _excess(r, r0, dr, 1.0)
    if name == "DSigma_area":  # geometric areas
        dr = np.sqrt(2) / 2 * at if dr is None else dr
        return (r < at) / (np.pi * at**2) - ((r >= at) & (r < at + dr)) / (np.pi * ((at + dr) ** 2 - at**2))
    if name == "DSigma_kernel_map":  # geometric areas, less the mean
        dr = 0.5 if dr is None else dr
        k = (r < at) / (np.pi * at**2) - ((r >= at) & (r < at + dr)) / (np.pi * ((at + dr) ** 2 - at**2))
        return (k - k.mean()) * pixel**2
    raise NotImplementedError(f"Filter Type not implemented: {name}")


def running_weights(r: np.ndarray, edges) -> np.ndarray:
    """(bins, pixels): the running excess by bins of distance, as weights of the pixels; NaN in a bin without pixels.

    Pixels are taken by distance, equal ones in the order given. A pixel's excess is the mean of all pixels up to it less
    its own value, so each pixel adds to the excess of all behind it: its weight in a bin is the bin's mean of
    1 / (number of pixels so far) over those, less its own share.
    """
    order = np.argsort(r, kind="stable")
    bins = np.searchsorted(np.asarray(edges, float), r[order], "right") - 1
    out = np.full((len(edges) - 1, len(r)), np.nan)
    for b in range(len(edges) - 1):
        inside = bins == b
        if inside.any():
            share = np.where(inside, 1 / np.arange(1, len(r) + 1), 0.0)
            out[b, order] = (np.cumsum(share[::-1])[::-1] - inside) / inside.sum()
    return out


@dataclass(frozen=True)
class Kernels:
    """A filter's weights for each radius, over the square of pixels around an object.

    ``edges`` are the running excess's bins, one more than radii, in units of the radii; ``pixel`` is a pixel's length, by
    whose square an excess is divided.
    """

    name: str | Callable
    radii: tuple
    geometry: Geometry
    pixel: float = 1.0
    dr: float | None = None
    edges: tuple | None = None

    @classmethod
    def of(cls, name: str | Callable, radii, pixels_per_unit: float, pixel: float = 1.0, dr: float | None = None, edges=None) -> Kernels:
        radii = tuple(float(r) for r in radii)
        return cls(name, radii, Geometry.of(name if isinstance(name, str) else "", np.array(radii), pixels_per_unit), pixel, dr, edges and tuple(map(float, edges)))

    @property
    def by_distance(self) -> bool:
        """Whether equal distances have equal weights."""
        return self.name != "DSigma_mccarthy"

    @property
    def pixels(self) -> int:
        return (2 * self.geometry.half + 1) ** 2

    def flat(self, i: int) -> np.ndarray:
        _, r = self.geometry.distances()
        if self.name == "DSigma_mccarthy":
            if self.edges is None:
                raise ValueError("the running excess needs the edges of its bins")
            return running_weights(r, self.edges)[i] / self.pixel**2
        return weights(self.name, r, self.radii[i], self.pixel, dr=self.dr)

    def square(self, i: int) -> np.ndarray:
        side = 2 * self.geometry.half + 1
        return np.asarray(self.flat(i), float).reshape(side, side)

    def table(self, spark: SparkSession) -> DataFrame:
        """(radius, q, w): the weight of each pixel at squared offset q; or (radius, di, dj, w)."""
        q, _ = self.geometry.distances()
        if self.by_distance:
            first = np.unique(q, return_index=True)
            rows = [(at, int(a), float(w)) for i, at in enumerate(self.radii) for a, w in zip(first[0], self.flat(i)[first[1]], strict=True) if w]
            return spark.createDataFrame(rows, "radius double, q int, w double")
        half, side = self.geometry.half, 2 * self.geometry.half + 1
        rows = [(at, p // side - half, p % side - half, float(w)) for i, at in enumerate(self.radii) for p, w in enumerate(self.flat(i)) if not np.isnan(w)]
        return spark.createDataFrame(rows, "radius double, di int, dj int, w double")

    def empty(self) -> list[float]:
        """Radii whose bin has no pixel."""
        return [] if self.by_distance else [at for i, at in enumerate(self.radii) if np.isnan(self.flat(i)).all()]


def running_excess(pixels: DataFrame, edges: list[float], key: str = "object_id") -> DataFrame:
    """Excess surface density by running means: pixels (key, r, tie, value) sorted by distance, the mean so far less
    the pixel's value, averaged by bins of ``edges``. An empty bin is null."""
    so_far = Window.partitionBy(key).orderBy("r", "tie").rowsBetween(Window.unboundedPreceding, 0)
    excess = pixels.withColumn("d", F.avg("value").over(so_far) - F.col("value"))
    number = sum(((F.col("r") >= e).cast("int") for e in edges), F.lit(0)) - 1
    binned = excess.withColumn("bin", number).where((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1)).groupBy(key, "bin").agg(F.avg("d").alias("value"), F.count("*").alias("n"))
    bins = pixels.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return pixels.select(key).distinct().crossJoin(F.broadcast(bins)).join(binned, [key, "bin"], "left").select(key, "bin", "value", F.coalesce("n", F.lit(0)).alias("n"))


def core_minus_border(pixels: DataFrame, radius: float, connectivity: int = 8, key: str = "object_id") -> DataFrame:
    """Mean of the core (r < radius) less the mean of its border: the core's 4 or 8 neighbours that aren't core."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (connectivity == 8 or a * b == 0)]
    core = pixels.where(F.col("r") < radius)
    moved = core.select(key, F.explode(F.array(*[F.struct((F.col("di") + a).alias("di"), (F.col("dj") + b).alias("dj")) for a, b in steps])).alias("s")).select(key, "s.di", "s.dj").distinct()
    border = pixels.join(moved, [key, "di", "dj"], "left_semi").where(F.col("r") >= radius)
    mean = F.avg(F.when(~F.isnan("value"), F.col("value")))
    return core.groupBy(key).agg(mean.alias("core")).join(border.groupBy(key).agg(mean.alias("border")), key, "left").select(key, "core", "border", (F.col("core") - F.col("border")).alias("value"))


def _spline_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot cubic spline."""
    n, h = len(x), np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(a, b)


def spline(x, y, at, derivative: bool = False) -> np.ndarray:
    """Not-a-knot cubic spline through a profile of four points or more, or its derivative."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    m, h = _spline_slopes(x, y), np.diff(x)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    s, w = at - x[i], h[i]
    c1 = (y[i + 1] - y[i]) / w - w * (2 * m[i] + m[i + 1]) / 6
    c2, c3 = m[i] / 2, (m[i + 1] - m[i]) / (6 * w)
    return c1 + 2 * c2 * s + 3 * c3 * s**2 if derivative else y[i] + s * (c1 + s * (c2 + s * c3))


def cap_from_mass(r, radii, mass) -> np.ndarray:
    """2 M(r) - M(sqrt(2) r) of a cumulative profile."""
    return 2 * spline(radii, mass, r) - spline(radii, mass, np.sqrt(2) * np.asarray(r, float))


def delta_sigma_from_mass(r, radii, mass) -> np.ndarray:
    """M / (pi r^2) - M' / (2 pi r)."""
    r = np.asarray(r, float)
    return spline(radii, mass, r) / (np.pi * r**2) - spline(radii, mass, r, True) / (2 * np.pi * r)
