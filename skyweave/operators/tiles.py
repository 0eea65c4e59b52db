"""Dense grids as tiles: a row is a block of cells with its values as one array, and no cell carries its indices.

A tile has bounded extents along the grid's leading axes and is whole along the others, so that lines of the last axis
lie in one row: sums along it, transforms and maps of cells are narrow. What moves cells between tiles (turning the axes,
projecting, filling) cuts tiles into pieces, shuffles the pieces by their new tile, and adds them up one tile after the
other, so that a task holds a tile and a batch of pieces whatever the grid's size.

Transforms of real grids keep half of the spectrum: the last axis has n // 2 + 1 modes, which stand for their conjugates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Cells of a tile, unless a single line has more.
TILE_CELLS = 1 << 17
#: Planes of up to so many cells are transformed along both axes at once.
PLANE_CELLS = 1 << 17
_NAMES = "ijk"
_ROW, _PIECE = "tile long, data binary", "tile long, at array<int>, size array<int>, data binary"


@dataclass(frozen=True)
class Tiles:
    """Rows (tile, data) of a grid of ``shape``; ``sides`` are a tile's extents along its leading axes.

    ``axes`` names the axes in their present order. Values are doubles, or complex after ``transform``; then ``halved`` is
    the axis with half of the modes, and its full size.
    """

    rows: DataFrame
    shape: tuple
    sides: tuple
    axes: str
    dtype: str = "<f8"
    halved: tuple | None = None

    @property
    def blocks(self) -> tuple:
        return tuple(-(-n // s) for n, s in zip(self.shape, self.sides, strict=False))

    def box(self, tile: int) -> tuple[list[int], list[int]]:
        """The first cell of a tile, and its extents."""
        at = list(np.unravel_index(tile, self.blocks)) if self.sides else []
        low = [int(b) * s for b, s in zip(at, self.sides, strict=True)] + [0] * (len(self.shape) - len(self.sides))
        return low, [min(s, n - a) for s, n, a in zip((*self.sides, *self.shape[len(self.sides) :]), self.shape, low, strict=True)]

    def places(self, tile: int) -> list[np.ndarray]:
        """Indices of a tile's cells by axis, as arrays that broadcast."""
        low, size = self.box(tile)
        return [np.arange(a, a + n).reshape([-1 if d == x else 1 for d in range(len(low))]) for x, (a, n) in enumerate(zip(low, size, strict=True))]


def sides_for(shape: tuple, whole: int = 1) -> tuple:
    """Equal extents along the leading axes, with about TILE_CELLS cells of a tile."""
    lead = len(shape) - whole
    lines = max(1, TILE_CELLS // prod(shape[lead:]))
    out: list[int] = []
    for a in range(lead - 1, -1, -1):  # a short axis leaves more to the others
        side = min(shape[a], max(1, int(round(lines ** (1 / (a + 1)) - 0.499))))
        out.insert(0, side)
        lines = max(1, lines // side)
    return tuple(out)


def layout(shape: tuple, axes: str | None = None, whole: int = 1) -> Tiles:
    return Tiles(None, tuple(shape), sides_for(tuple(shape), whole), axes or _NAMES[: len(shape)])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"tile": pa.int64(), "at": pa.list_(pa.int32()), "size": pa.list_(pa.int32()), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def _each(t: Tiles, make: Callable[[int, np.ndarray], Iterator[tuple]], names: list[str]):
    """A task's tiles, one by one: ``make(tile, array)`` gives rows, which go on a tile's at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = np.frombuffer(data.as_buffer(), t.dtype).reshape(t.box(tile)[1])
                if rows := list(make(tile, a)):
                    yield _batch(rows, names)

    return run


def mapped(t: Tiles, fn: Callable[[Tiles, int, np.ndarray], np.ndarray], **new) -> Tiles:
    """Each tile's array by ``fn(tiles, tile, array)``; ``new`` are fields that change with it."""
    out = replace(t, rows=None, **new)
    bare = replace(t, rows=None)
    make = lambda tile, a: [(tile, np.ascontiguousarray(fn(bare, tile, a), out.dtype).tobytes())]
    return replace(out, rows=t.rows.mapInArrow(_each(bare, make, ["tile", "data"]), _ROW))


def reduced(t: Tiles, fn: Callable[[Tiles, int, np.ndarray], dict], schema: str) -> DataFrame:
    """Rows of ``schema`` from each tile: ``fn`` gives its columns as arrays."""
    bare = replace(t, rows=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = fn(bare, tile, np.frombuffer(data.as_buffer(), bare.dtype).reshape(bare.box(tile)[1]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got.values()], names=list(got))

    return t.rows.mapInArrow(run, schema)


def paired(one: Tiles, two: Tiles, fn: Callable[[Tiles, int, np.ndarray, np.ndarray], np.ndarray]) -> Tiles:
    """Tiles of two grids of one layout, by ``fn(tiles, tile, a, b)``."""
    if (one.shape, one.sides, one.axes) != (two.shape, two.sides, two.axes):
        raise ValueError("the grids have different tiles")
    bare, kind = replace(one, rows=None), two.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                size = bare.box(tile)[1]
                x, y = np.frombuffer(x.as_buffer(), bare.dtype).reshape(size), np.frombuffer(y.as_buffer(), kind).reshape(size)
                yield _batch([(tile, np.ascontiguousarray(fn(bare, tile, x, y), bare.dtype).tobytes())], ["tile", "data"])

    both = one.rows.join(two.rows.withColumnRenamed("data", "other"), "tile").select("tile", "data", "other")
    return replace(one, rows=both.mapInArrow(run, _ROW))


def _assembled(pieces: DataFrame, out: Tiles) -> Tiles:
    """Tiles as the sums of pieces (tile, at, size, data), of which every tile has one at least."""
    bare = replace(out, rows=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, low = -1, None, []
        for b in batches:
            for tile, at, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if tile != held:
                    if total is not None:
                        yield _batch([(held, total.tobytes())], ["tile", "data"])
                    held, (low, whole) = tile, bare.box(tile)
                    total = np.zeros(whole, bare.dtype)
                total[tuple(slice(a - o, a - o + n) for a, o, n in zip(at, low, size, strict=True))] += np.frombuffer(data.as_buffer(), bare.dtype).reshape(size)
        if total is not None:
            yield _batch([(held, total.tobytes())], ["tile", "data"])

    return replace(out, rows=pieces.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, _ROW))


def _cut(out: Tiles, low: list[int], a: np.ndarray) -> Iterator[tuple]:
    """Pieces of an array that lies at ``low`` of the grid ``out``."""
    high = [x + n for x, n in zip(low, a.shape, strict=True)]
    spans = [range(x // s, (y - 1) // s + 1) for x, y, s in zip(low, high, out.sides, strict=False)]
    for block in product(*spans):
        lo = [max(x, b * s) for x, b, s in zip(low, block, out.sides, strict=False)] + low[len(block) :]
        hi = [min(y, (b + 1) * s) for y, b, s in zip(high, block, out.sides, strict=False)] + high[len(block) :]
        part = a[tuple(slice(x - o, y - o) for x, y, o in zip(lo, hi, low, strict=True))]
        yield int(np.ravel_multi_index(block, out.blocks)) if block else 0, lo, list(part.shape), np.ascontiguousarray(part, out.dtype).tobytes()


def filled(cells: DataFrame, shape: tuple, value: str = "value", whole: int | None = None) -> Tiles:
    """Tiles of a sparse grid (i, j[, k], value) with a row for each cell; absent cells are 0.

    Tiles of cubes are whole along the last two axes, if such a plane is small, and along the last one otherwise.

    Cells go to their tiles as two numbers, and are put in their places tile by tile.
    """
    whole = whole or (2 if len(shape) == 3 and shape[1] * shape[2] <= PLANE_CELLS else 1)
    out = layout(shape, whole=whole)
    names, lead = out.axes, len(out.sides)
    tile, at = F.lit(0).cast("long"), F.lit(0).cast("long")
    for x, (c, n) in enumerate(zip(names, shape, strict=True)):
        if x < lead:
            side = out.sides[x]
            tile = tile * out.blocks[x] + F.floor(F.col(c) / side)
            at = at * F.least(F.lit(side), F.lit(n) - F.floor(F.col(c) / side) * side) + F.col(c) % side
        else:
            at = at * n + F.col(c)
    rows = cells.select(tile.alias("tile"), at.cast("int").alias("at"), F.col(value).cast("double").alias("value"))
    every = cells.sparkSession.range(prod(out.blocks)).select(F.col("id").alias("tile"), F.lit(0).alias("at"), F.lit(0.0).alias("value"))
    bare = replace(out, rows=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = -1, None
        for b in batches:
            tiles, at, value = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(tiles)) + 1, [len(tiles)])) if len(tiles) else np.zeros(1, int)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if tiles[lo] != held:
                    if total is not None:
                        yield _batch([(held, total.tobytes())], ["tile", "data"])
                    held = int(tiles[lo])
                    total = np.zeros(prod(bare.box(held)[1]))
                total += np.bincount(at[lo:hi], value[lo:hi], len(total))
        if total is not None:
            yield _batch([(held, total.tobytes())], ["tile", "data"])

    return replace(out, rows=rows.unionByName(every).repartition("tile").sortWithinPartitions("tile").mapInArrow(run, _ROW))


def cells(t: Tiles, name: str = "value", keep: Callable | None = None) -> DataFrame:
    """(axes, value): a row for every cell, or those of which ``keep(array)`` holds; complex values as re and im."""
    names = [x for x in _NAMES if x in t.axes]

    def rows(tiles: Tiles, tile: int, a: np.ndarray) -> dict:
        on = (np.ones(a.shape, bool) if keep is None else keep(a)).ravel()
        at = {x: np.broadcast_to(p, a.shape).ravel()[on].astype(np.int32) for x, p in zip(tiles.axes, tiles.places(tile), strict=True)}
        a = a.ravel()[on]
        return {**{x: at[x] for x in names}, **({"re": a.real, "im": a.imag} if tiles.dtype == "<c16" else {name: a})}

    return reduced(t, rows, ", ".join(f"{x} int" for x in names) + (", re double, im double" if t.dtype == "<c16" else f", {name} double"))


def total(t: Tiles) -> DataFrame:
    """(total) of all cells, one row."""
    return reduced(t, lambda _, __, a: {"s": np.array([a.sum()])}, "s double").agg(F.sum("s").alias("total"))


def _against_mean(t: Tiles, ratio: bool) -> Tiles:
    bare, n = replace(t, rows=None), float(prod(t.shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, data, m in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                a, m = np.frombuffer(data.as_buffer(), bare.dtype), m / n
                yield _batch([(tile, (a - m if not ratio else a / m - 1 if m else np.full(len(a), np.nan)).tobytes())], ["tile", "data"])

    return replace(t, rows=t.rows.crossJoin(F.broadcast(total(t))).mapInArrow(run, _ROW))  # one row


def subtract_mean(t: Tiles) -> Tiles:
    return _against_mean(t, False)


def overdensity(t: Tiles) -> Tiles:
    """Over the mean, less 1; a grid whose mean is 0 gives NaN."""
    return _against_mean(t, True)


def turned(t: Tiles, order: tuple, whole: int = 1) -> Tiles:
    """The same grid with its axes in another order, whole along the last ones."""
    shape = tuple(t.shape[x] for x in order)
    out = replace(t, rows=None, shape=shape, sides=sides_for(shape, whole), axes="".join(t.axes[x] for x in order))
    bare = replace(t, rows=None)

    def make(tile: int, a: np.ndarray) -> Iterator[tuple]:
        low = bare.box(tile)[0]
        return _cut(out, [low[x] for x in order], a.transpose(order))

    return _assembled(t.rows.mapInArrow(_each(bare, make, ["tile", "at", "size", "data"]), _PIECE), out)


def projected(t: Tiles, axis: str) -> Tiles:
    """Sums along an axis: within tiles first, then what lies in different tiles."""
    x = t.axes.index(axis)
    shape = tuple(n for a, n in enumerate(t.shape) if a != x)
    names = t.axes.replace(axis, "")
    out = Tiles(None, shape, sides_for(shape), names, t.dtype)
    bare = replace(t, rows=None)

    def make(tile: int, a: np.ndarray) -> Iterator[tuple]:
        low = bare.box(tile)[0]
        return _cut(out, low[:x] + low[x + 1 :], a.sum(axis=x))

    return _assembled(t.rows.mapInArrow(_each(bare, make, ["tile", "at", "size", "data"]), _PIECE), out)


def kept(t: Tiles) -> Tiles:
    """The same tiles, written and read again: for grids that are used more than once."""
    return replace(t, rows=stored(t.rows))


# ---------------------------------------------------------------- transforms


def transform(t: Tiles) -> Tiles:
    """The half spectrum of a real grid in the order of its axes; the result's axes are turned, the last one first in order."""
    halved = (t.axes[-1], t.shape[-1])
    shape = (*t.shape[:-1], t.shape[-1] // 2 + 1)
    if len(t.shape) == 3 and t.shape[1] * t.shape[2] <= PLANE_CELLS:
        t = t if len(t.sides) == 1 else turned(t, (0, 1, 2), 2)
        out = mapped(t, lambda _, __, a: np.fft.rfft2(a, axes=(1, 2)), shape=shape, dtype="<c16", halved=halved)
        out = turned(out, (1, 2, 0))
    else:
        out = mapped(t, lambda _, __, a: np.fft.rfft(a, axis=-1), shape=shape, dtype="<c16", halved=halved)
        for _ in range(len(shape) - 2):
            out = mapped(turned(out, (2, 0, 1)), _along_last)
        out = turned(out, (1, 0) if len(shape) == 2 else (2, 0, 1))
    return mapped(out, _along_last)


def _along_last(_, __, a: np.ndarray) -> np.ndarray:
    return np.fft.fft(a, axis=-1)


def _back(_, __, a: np.ndarray) -> np.ndarray:
    return np.fft.ifft(a, axis=-1)


def inverse(t: Tiles) -> Tiles:
    """The real grid of a half spectrum as ``transform`` gives it, with the axes in their first order."""
    axis, n = t.halved
    order = "".join(sorted(t.axes, key=_NAMES.index))
    t = mapped(t, _back)  # along the axis that comes first in order
    if len(t.shape) == 3 and prod(t.shape[:2]) <= PLANE_CELLS and t.axes[:2] == order[1:]:
        t = turned(t, (2, 0, 1), 2)
        return mapped(t, lambda _, __, a: np.fft.irfft(np.fft.ifft(a, axis=1), n, axis=2), shape=(*t.shape[:-1], n), dtype="<f8", halved=None)
    for x in order[1:-1]:
        rest = [a for a in t.axes if a != x]
        t = mapped(turned(t, tuple(t.axes.index(a) for a in (*rest, x))), _back)
    t = turned(t, tuple(t.axes.index(a) for a in order))
    return mapped(t, lambda _, __, a: np.fft.irfft(a, n, axis=-1), shape=(*t.shape[:-1], n), dtype="<f8", halved=None)


def waves(t: Tiles, tile: int, box: float) -> dict[str, np.ndarray]:
    """Wavenumbers of a tile's modes by axis, as arrays that broadcast. The Nyquist mode is negative, as in a full transform."""
    out = {}
    for x, p, size in zip(t.axes, t.places(tile), t.shape, strict=True):
        n = t.halved[1] if t.halved and x == t.halved[0] else size
        out[x] = np.where(2 * p < n, p, p - n) * (2 * np.pi / box)
    return out


def conjugates(t: Tiles, tile: int) -> np.ndarray:
    """How many modes of the full spectrum each mode of a tile stands for: itself, and its conjugate where that was left out."""
    x = t.axes.index(t.halved[0])
    p, n = t.places(tile)[x], t.halved[1]
    return np.where((p == 0) | (2 * p == n), 1.0, 2.0)


def window(t: Tiles, tile: int) -> np.ndarray:
    """Transform of the triangular-shaped-cloud assignment at a tile's modes."""
    out = np.ones(1)
    for x, k in waves(t, tile, 2 * np.pi).items():  # whole numbers
        n = t.halved[1] if x == t.halved[0] else t.shape[t.axes.index(x)]
        out = out * np.sinc(k / n) ** 3
    return out


def filtered(t: Tiles, factor: Callable[[dict], np.ndarray], box: float) -> Tiles:
    """Modes times ``factor(wavenumbers by axis)``."""
    return mapped(t, lambda tiles, tile, a: a * factor(waves(tiles, tile, box)))


def power(one: Tiles, two: Tiles | None, box: float, edges: list[float] | None = None, mas: bool = True) -> DataFrame:
    """(bin, k, p, n_modes): auto or cross power of half spectra by bins of k, as ``spectra.power`` gives it.

    A tile gives a row for each bin, so that the spectrum itself isn't shuffled.
    """
    n, auto = one.halved[1], two is None
    both = one if auto else paired(one, two, lambda _, __, a, b: a * np.conj(b))

    def sums(t: Tiles, tile: int, a: np.ndarray) -> dict:
        k = np.broadcast_to(np.sqrt(sum(x**2 for x in waves(t, tile, box).values())), a.shape)
        p = (np.abs(a) ** 2 if auto else a.real) * (box**3 / float(n) ** 6)
        if mas:
            p = p / window(t, tile) ** 2
        times = np.broadcast_to(conjugates(t, tile), a.shape)
        if edges is None:
            number, keep = np.rint(k / (2 * np.pi / box)).astype(int), (k > 0) & (k <= np.pi * n / box)
        else:
            number = np.searchsorted(np.array(edges, float), k, "right") - 1
            keep = (k > 0) & (number >= 0) & (number < len(edges) - 1)
        number, times, k, p = (x[keep] for x in (number, times, k, p))
        some = np.unique(number)
        total = lambda w: np.bincount(number, w)[some] if len(some) else np.zeros(0)
        return {"bin": some.astype(np.int32), "k": total(times * k), "p": total(times * p), "n": total(times)}

    found = reduced(both, sums, "bin int, k double, p double, n double").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("k", "p", "n")])
    return found.select("bin", (F.col("k") / F.col("n")).alias("k"), (F.col("p") / F.col("n")).alias("p"), F.col("n").cast("long").alias("n_modes"))


def correlation(one: Tiles, two: Tiles | None, box: float) -> DataFrame:
    """(bin, r, xi): the inverse transform of the power of half spectra, averaged in shells of a cell's width."""
    n = one.halved[1]
    prod_ = mapped(one, lambda _, __, a: np.abs(a) ** 2 / n**3) if two is None else paired(one, two, lambda _, __, a, b: a * np.conj(b) / n**3)

    def sums(t: Tiles, tile: int, a: np.ndarray) -> dict:
        d = [np.where(2 * p < n, p, p - n) for p in t.places(tile)]
        r = np.broadcast_to(np.sqrt(sum(x * x for x in d)), a.shape).ravel()
        number = np.rint(r).astype(int)
        some = np.unique(number)
        total = lambda w: np.bincount(number, w)[some]
        return {"bin": some.astype(np.int32), "r": total(r), "xi": total(a.ravel()), "n": total(np.ones(a.size))}

    found = reduced(inverse(prod_), sums, "bin int, r double, xi double, n double").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("r", "xi", "n")])
    return found.select("bin", (F.col("r") / F.col("n") * F.lit(box / n)).alias("r"), (F.col("xi") / F.col("n")).alias("xi"))


def smoothed(t: Tiles, kernel: np.ndarray) -> Tiles:
    """A 2D grid under the same periodic kernel along both axes."""
    n, line = len(kernel), np.fft.rfft(kernel)
    full = np.fft.fft(kernel)
    if t.shape != (n, n):
        raise ValueError("the kernel has another length than the grid")

    def factor(tiles: Tiles, tile: int, a: np.ndarray) -> np.ndarray:
        p = dict(zip(tiles.axes, tiles.places(tile), strict=True))
        other = next(x for x in tiles.axes if x != tiles.halved[0])
        return a * line[p[tiles.halved[0]]] * full[p[other]]

    return inverse(mapped(transform(t), factor))


# ---------------------------------------------------------------- maps under many kernels


def correlated(t: Tiles, kernel: Callable[[int], np.ndarray], count: int) -> Tiles:
    """Grids "rij" of a 2D grid f: at each cell c the sum over offsets d of w_r(d) f(c + d), for ``count`` kernels.

    ``kernel(r)`` gives the weights of a square of offsets around 0, of any size; it is called where tiles are. One
    transform serves all kernels; each takes a product, and half of a complex grid through the shuffle.
    """
    spectrum, n = transform(t), t.shape[1]
    out = Tiles(None, (count, t.shape[0], n // 2 + 1), (1, *sides_for((t.shape[0], n))), "r" + t.axes, "<c16", (t.axes[1], n))
    bare, high = replace(spectrum, rows=None), t.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [(tile, np.frombuffer(x.as_buffer(), "<c16").reshape(bare.box(tile)[1])) for tile, x in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            for r in range(count):
                w = kernel(r)
                d = np.arange(w.shape[0]) - w.shape[0] // 2
                line = np.zeros((len(d), high))  # by offset along j, and along i round the grid
                np.add.at(line.T, d % high, w)
                line = np.fft.fft(line, axis=1)
                for tile, a in held:
                    low = bare.box(tile)[0]
                    wave = np.exp(-2j * np.pi / n * np.outer(np.arange(low[0], low[0] + len(a)), d))
                    part = np.fft.ifft(a * np.conj(wave @ line), axis=1)
                    yield _batch(list(_cut(out, [r, 0, low[0]], part.T[None])), ["tile", "at", "size", "data"])

    found = _assembled(spectrum.rows.mapInArrow(run, _PIECE), out)
    return mapped(found, lambda _, __, a: np.fft.irfft(a, n, axis=-1), shape=(count, high, n), dtype="<f8", halved=None)


def looked_up(t: Tiles, at: DataFrame) -> DataFrame:
    """(i, j, r, value) of grids "rij" at the cells of ``at`` (i, j), each given once.

    A tile meets one row with all that is asked of it, which is a number for each of its cells at most.
    """
    bare, thick, blocks = replace(t, rows=None), t.sides[1], t.blocks[1]
    width = t.shape[2]
    asked = at.select("i", "j").distinct().groupBy(F.floor(F.col("i") / thick).alias("block")).agg(F.collect_list(((F.col("i") % thick) * width + F.col("j")).cast("int")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, data, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                want = want.values.to_numpy()
                r, i, _ = bare.box(tile)[0]
                n = len(want)
                yield pa.RecordBatch.from_arrays([pa.array((want // width + i).astype(np.int32)), pa.array((want % width).astype(np.int32)), pa.array(np.full(n, r, np.int32)), pa.array(np.frombuffer(data.as_buffer(), "<f8")[want])], names=["i", "j", "r", "value"])

    both = t.rows.withColumn("block", F.col("tile") % blocks).join(asked, "block").select("tile", "data", "at")
    return both.mapInArrow(run, "i int, j int, r int, value double")
