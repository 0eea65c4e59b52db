"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed for first occurrences.

The result is one compressed keep bitmap for each document, not text; ``apply_bitmaps`` filters texts with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, stored

#: A line key has at least so many code points to count as repeatable.
MIN_POINTS = 20
#: A key found in at least so many documents keeps only the lines of the largest document id.
MIN_DOCS = 3

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.list_(pa.int32()))])
_SEEN = "h1 long, h2 long, doc_id long, text_key long, pos array<int>, told int"


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _long_enough(key: bytes, points: int) -> bool:
    return len(key) >= points and (len(key) >= 4 * points or len(key.decode("utf-8", "replace")) >= points)


def _hash_lines(points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            h1, h2, doc, text_key, pos = [], [], [], [], []
            for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own: dict[bytes, list[int]] = {}
                for i, line in enumerate(t.split(b"\n")):
                    if len(line) >= points and _long_enough(key := line_key(line), points):
                        own.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                for digest, at in own.items():
                    h1.append(int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(int.from_bytes(digest[8:], "little", signed=True))
                    doc.append(d)
                    text_key.append(k)
                    pos.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((h1, h2, doc, text_key, pos), _LINES, strict=True)], schema=_LINES)

    return run


class _Run:
    """The lines of one hash in a partition, in falling document order: which are dropped, and which edges decide."""

    def __init__(self, key: tuple[int, int], first: bool, need: int) -> None:
        self.key, self.first, self.need = key, first, need
        self.docs: list[int] = []  # the first ``need`` documents
        self.waiting: list[pa.Table] = []  # lines of all but the first of fewer documents

    def feed(self, x: pa.Table) -> Iterator[pa.Table]:
        doc = x["doc_id"].to_numpy()
        new = np.concatenate(([not self.docs or doc[0] != self.docs[-1]], doc[1:] != doc[:-1]))
        place = len(self.docs) - 1 + np.cumsum(new)  # of full runs any number beyond the first
        self.docs += doc[new][: self.need - len(self.docs)].tolist()
        if self.first:
            yield _told(x.filter(pa.array(place == 0)), _UNDECIDED)
        self.waiting.append(x.filter(pa.array(place > 0)))
        if len(self.docs) == self.need:
            yield from (_told(w, _DROPPED) for w in self.waiting)
            self.waiting = []

    def end(self, last: bool) -> Iterator[pa.Table]:
        if self.first or last:
            yield from (_told(w, _UNDECIDED) for w in self.waiting)
            n = len(self.docs)
            yield pa.table([pa.array([self.key[0]] * n), pa.array([self.key[1]] * n), pa.array(self.docs, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array([_SUMMARY] * n, pa.int32())], names=[*_LINES.names, "told"])


_DROPPED, _UNDECIDED, _SUMMARY = range(3)


def _told(x: pa.Table, what: int) -> pa.Table:
    return x.append_column("told", pa.array(np.full(len(x), what, np.int32)))


def _stream(min_docs: int):
    """Over lines sorted by hash and falling document: drop the lines of all but the first document of a long run.

    Runs go on from batch to batch. The first and the last run of a partition may go on in another one; what depends
    on that passes undecided, a few documents' lines, with a summary of the run: its first ``min_docs`` documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Run | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = pa.Table.from_batches([b])
            h1, h2, doc = (x.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]), [True])))
            # whole runs, all at once
            lo, hi = int(edges[1]), int(edges[-2])
            out: list[pa.Table] = []
            key = int(h1[0]), int(h2[0])
            if held is None or held.key != key:
                out += held.end(False) if held is not None else ()
                held = _Run(key, held is None, min_docs)
            out += held.feed(x.slice(0, lo))
            if hi > lo:
                new = np.zeros(hi - lo, bool)
                new[edges[1:-2] - lo] = True
                run_of = np.cumsum(new) - 1
                other = new | np.concatenate(([True], doc[lo + 1 : hi] != doc[lo : hi - 1]))
                drop = (np.bincount(run_of[other])[run_of] >= min_docs) & (doc[lo:hi] != doc[edges[1:-2]][run_of])
                out.append(_told(x.slice(lo, hi - lo).filter(pa.array(drop)), _DROPPED))
            if len(edges) > 2:
                out += held.end(False)
                held = _Run((int(h1[-1]), int(h2[-1])), False, min_docs)
                out += held.feed(x.slice(hi))
            for t in out:
                yield from t.to_batches()
        if held is not None:
            for t in held.end(True):
                yield from t.to_batches()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, dropped = [], []
        for at in b.column(2).to_pylist():
            keep = np.ones(max(at) // 8 * 8 + 8, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(len(set(at)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary()), pa.array(dropped, pa.int64())], names=["doc_id", "text_key", "keep", "n_dropped"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, keep, n_dropped) of the documents that lose lines.

    ``keep`` is a zlib-compressed bit for each line up to the last dropped one; lines beyond stay. ``text_key``
    tells rows apart that share an id (they count as one document; equal rows get equal bitmaps). Rows with a null
    id, and null or empty texts, neither lose lines nor count. An empty table gives no bitmaps.
    """
    text = F.col(text_col)
    rows = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text) >= min_points)).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("t"))
    lines = rows.mapInArrow(_hash_lines(min_points), "h1 long, h2 long, doc_id long, text_key long, pos array<int>")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("text_key")]
    seen = cut(stored(lines).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _SEEN))
    # two runs of each partition at most, with min_docs documents each
    edges = seen.where(F.col("told") == _SUMMARY).groupBy("h1", "h2").agg(F.size(F.collect_set("doc_id")).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    late = seen.where(F.col("told") == _UNDECIDED).join(F.broadcast(edges), ["h1", "h2"]).where(F.col("doc_id") != F.col("last"))
    drops = seen.where(F.col("told") == _DROPPED).select("doc_id", "text_key", "pos").unionByName(late.select("doc_id", "text_key", "pos"))
    per_doc = drops.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    return per_doc.mapInArrow(_pack, "doc_id long, text_key long, keep binary, n_dropped long")


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[int, bytes]:
    """The number of lines of a text, and the lines that its bitmap keeps, joined by a line feed."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return len(lines), text or b""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
    return len(lines), b"\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, keep, n_dropped) for every row of ``docs``; ``keep`` is null where nothing is dropped."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.join(bitmaps, ["doc_id", "text_key"], "left").select("doc_id", "text", "keep", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): the texts with the lines that their bitmaps keep; a null text becomes ''."""
    rows = with_bitmaps(docs, bitmaps, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("t"), "keep", "n_dropped")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            got = [kept_lines(t, k) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), b.column(3), pa.array([t for _, t in got], pa.binary())], names=["doc_id", "n_lines", "n_dropped", "t"])

    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, t binary").select("doc_id", "n_lines", "n_dropped", F.col("t").cast("string").alias("text"))
