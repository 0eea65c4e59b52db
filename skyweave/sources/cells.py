"""Particles in files along a space-filling curve, and reads of the ranges of it that a region meets.

A cell's number on the curve interleaves the bits of its indices, so that a file, and a row group within it, has cells
that are near to each other. A table of the files' ranges tells which to open, and the row groups' statistics which of
their parts to read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import cell

#: Column of the cell's number, and the folder beside the files with their ranges.
CODE, INDEX = "morton", "_index"
#: Ranges of a region at most: beyond that, the nearest are merged, and the cells between them read too.
RANGES = 64


def _code(cells: list[Column], bits: int) -> Column:
    out = F.lit(0).cast("long")
    for b in range(bits):
        for x, c in enumerate(cells):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 3 * b + 2 - x))
    return out


def code_of(cells: tuple[int, ...]) -> int:
    """A cell's number: the bits of its indices, the first index's highest."""
    return sum(((c >> b) & 1) << (3 * b + 2 - x) for b in range(max(cells).bit_length()) for x, c in enumerate(cells))


def _bits(n: int) -> int:
    return max(1, (n - 1).bit_length())


def write(particles: DataFrame, path: str, box: float, n: int, files: int | None = None, group_bytes: int = 32 << 20) -> str:
    """The particles, sorted by their cell's number among n cells a side; a cell of very many may fill several files."""
    rows = particles.withColumn(CODE, _code([cell(x, box, n) for x in "xyz"], _bits(n)))
    ranged = rows.repartitionByRange(*([files] if files else []), CODE, "x", "y", "z").sortWithinPartitions(CODE)
    ranged.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)
    name = F.col("_metadata.file_path")
    read = particles.sparkSession.read.parquet(path)
    read.groupBy(name.alias("file")).agg(F.min(CODE).alias("lo"), F.max(CODE).alias("hi"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{INDEX}")
    return path


def _spans(at: float, radius: float, box: float, n: int) -> list[tuple[int, int]]:
    """Runs of cells along one axis that an interval around ``at`` meets, periodically."""
    low, high = math.floor((at - radius) * n / box), math.floor((at + radius) * n / box)
    if high - low + 1 >= n:
        return [(0, n - 1)]
    low, high = low % n, high % n
    return [(low, high)] if low <= high else [(low, n - 1), (0, high)]


def ranges(spans: list[list[tuple[int, int]]], n: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Rising ranges of numbers that hold all cells of a region, by halving the cube of cells; ``most`` of them."""
    found: list[tuple[int, int]] = []

    def meets(x: int, a: int, b: int) -> int:
        """0 if no cell from a to b is in the region along an axis, 2 if all are."""
        if any(lo <= a and b <= hi for lo, hi in spans[x]):
            return 2
        return int(any(lo <= b and a <= hi for lo, hi in spans[x]))

    def visit(corner: tuple[int, ...], bits: int, code: int) -> None:
        side = 1 << bits
        kinds = [meets(x, a, min(a + side, n) - 1) if a < n else 0 for x, a in enumerate(corner)]
        if min(kinds) == 0:
            return
        if min(kinds) == 2 or bits == 0 or bits <= coarse:
            lo, hi = code, code + (1 << 3 * bits) - 1
            if found and found[-1][1] + 1 >= lo:
                found[-1] = (found[-1][0], hi)
            else:
                found.append((lo, hi))
            return
        half = bits - 1
        for child in range(8):
            visit(tuple(a + ((child >> (2 - x)) & 1) * (1 << half) for x, a in enumerate(corner)), half, code + (child << 3 * half))

    # blocks no finer than a 16th of the region: its surface has few of them, whatever n is
    widest = max(hi - lo + 1 for s in spans for lo, hi in s)
    coarse = max(0, widest.bit_length() - 5)
    visit((0, 0, 0), _bits(n), 0)
    while len(found) > most:
        gap, i = min((b[0] - a[1], i) for i, (a, b) in enumerate(zip(found[:-1], found[1:], strict=True)))
        found[i : i + 2] = [(found[i][0], found[i + 1][1])]
    return found


def read_sphere(spark: SparkSession, path: str, centre: tuple[float, float, float], radius: float, box: float, n: int) -> DataFrame:
    """Particles nearer to ``centre`` than ``radius``, by the minimum image.

    Only files whose range meets one of the region's are opened, and of them only the row groups that do.
    """
    met = ranges([_spans(at, radius, box, n) for at in centre], n)
    index = spark.read.parquet(f"{path.rstrip('/')}/{INDEX}")
    files = [r["file"] for r in index.where(_any([(F.col("hi") >= a) & (F.col("lo") <= b) for a, b in met])).select("file").toLocalIterator()]
    rows = spark.read.parquet(*files) if files else spark.read.parquet(path).limit(0)
    rows = rows.where(_any([F.col(CODE).between(a, b) for a, b in met]))
    gap = lambda x, at: F.col(x) - F.lit(at) - F.lit(box) * F.rint((F.col(x) - F.lit(at)) / F.lit(box))
    return rows.where(sum((gap(x, at) * gap(x, at) for x, at in zip("xyz", centre, strict=True)), F.lit(0.0)) < F.lit(radius**2)).drop(CODE)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
