"""Helpers shared by the operators: Arrow plumbing, bounded tables, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import shared_dir, stored  # noqa: F401

#: Bytes of text that are worked on at once (a longer text by itself).
SLICE_BYTES = 2 << 20


def lean_batches(spark: SparkSession, size: int = 2 * SLICE_BYTES) -> None:
    """For an application's start: Arrow batches of ``size`` bytes at most, unless the session has smaller ones.

    The operators work with batches of any size and don't change the session; a small one saves executors' memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > size:
        spark.conf.set(key, f"{size}b")


def slices(batches: Iterator[pa.RecordBatch], *texts: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about SLICE_BYTES in the columns ``texts`` each, without a copy."""
    for b in batches:
        total = np.zeros(b.num_rows, np.int64)
        for i in texts:
            total += pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(total) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()  # a worker outlives its task


def cut(df: DataFrame) -> DataFrame:
    """Small tables: a reliable checkpoint, which Spark removes once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def hash_fraction(*cols: str, seed: int = 0):
    """A column in [0, 1) that depends on the given columns only."""
    h = F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, max_rows: int, *cols: str, seed: int = 7) -> DataFrame:
    """About ``max_rows`` rows at most, chosen by a hash of ``cols``: the same rows on every run."""
    n = df.count()
    if n <= max_rows:
        return df
    return df.where(hash_fraction(*cols, seed=seed) < F.lit(max_rows / n))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, y, t): id, label (0 or 1) and text of about ``max_rows`` labelled documents at most.

    The labels are sampled first; at that bound their ids are broadcast to find the texts in one pass. Null ids and
    labels teach nothing.
    """
    y = F.col(label_col)
    chosen = bounded_sample(labels.where(y.isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), y.cast("int").alias("y")), max_rows, "k")
    return stored(docs.select(F.col(key).alias("__k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), F.col("__k") == F.col("k")).select("k", "y", "t"))


def map_text(docs: DataFrame, text_col: str, fn: Callable[[list], dict], out: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Append to each row what ``fn(texts)`` computes, batch by batch; ``keep`` limits the columns passed on."""
    named = {f.name.lower() for f in out}
    passed = [c for c in (docs.columns if keep is None else keep) if c.lower() not in named]
    text = free_name(docs, "__text")
    schema = T.StructType([docs.schema[c] for c in passed] + out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in slices(batches, len(passed)):
            got = fn(b.column(len(passed)).to_pylist())
            cols = [b.column(i) for i in range(len(passed))]
            cols += [pa.array(got[f.name], type=arrow.field(f.name).type, from_pandas=True) for f in out]
            cols = [c.cast(arrow.field(i).type) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{text_col}`").alias(text)).mapInArrow(run, schema)


# ---------------------------------------------------------------- word hashes

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, _CHUNK + 4096), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def _chunk_words(buf: bytes, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of a buffer: a run without the bytes that lie ``between`` words."""
    b = np.frombuffer(buf, np.uint8)
    edge = np.diff(np.concatenate(([True], between[b], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _powers(_BASE, len(b)), out=sums[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), len(b))
    h = (sums[end] - sums[start]) * back[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(_BASE)), start, end


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of all texts, and each text's word count.

    With ``lower`` A-Z are lower-cased first. Texts of any length are hashed in chunks cut at white space.
    """
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owner, size
        if not held:
            return
        h, start, _ = _chunk_words(b"\n".join(held))
        offsets = np.cumsum([0, *(len(x) + 1 for x in held)])
        per = np.diff(np.searchsorted(start, offsets))
        np.add.at(counts, owner, per)
        found.append(h)
        held, owner, size = [], [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        t = t.lower() if lower else t
        at = 0
        while len(t) - at > _CHUNK:  # cut behind white space; a longer word is taken whole
            end = at + _CHUNK
            while end < len(t) and not _SPACE[t[end]]:
                end += 1
            held.append(t[at:end])
            owner.append(i)
            flush()
            at = end
        held.append(t[at:] if at else t)
        owner.append(i)
        size += len(t) - at + 1
        if size >= _CHUNK:
            flush()
    flush()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, w: int) -> np.ndarray:
    """Hash of every run of ``w`` words; a shorter sequence is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        span = min(w, n)
        h = np.zeros(n - span + 1, np.uint64)
        for i in range(span):
            h = h * _STEP + words[i : n - span + 1 + i]
        return mix(h + np.uint64(span))


def bit_filter(ids: DataFrame, col: str, bits: int = 24) -> np.ndarray:
    """A bitmap of ``2**bits`` bits (its size bound) that has the hash of every id; others may pass as well."""
    slot = F.xxhash64(F.col(col)).bitwiseAND(F.lit((1 << bits) - 1))
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 AS int)))").alias("b"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return out
