"""Ranked lexical search by sort-based accumulation.

Terms are looked up in the texts once, which gives postings: a row for each document with its length, the query terms it
holds and how often. Counts over them give the weights. Then each task has a range of the documents: the arrays of
(item, document, impact) of all matched terms are concatenated, keys of item and document packed into 32 bits are radix
sorted, runs of equal keys are summed, and a heap for each item keeps its best documents. The heaps of the ranges are
ranked in two steps, so no task takes all of an item's.

Items are worked on in blocks of bounded size, one after the other; a block's terms are what is broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard
from .common import _chunk_words, slices, stored

#: Terms of a block of items, with repeats in different items; an item with more is a block by itself.
BLOCK_TERMS = 1 << 18
#: Entries that are sorted at a time, and documents: the low bits of a key.
ENTRIES, DOC_BITS = 1 << 20, 12
#: Bytes of text that are split at a time.
CHUNK = 1 << 18

#: Bytes that belong to no term: ASCII but for letters and digits.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: The same bytes as blanks, for splitting.
_CUT = bytes(32 if _BETWEEN[x] else x for x in range(256))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Whole texts in buffers of about CHUNK bytes, with A-Z lower-cased, and the parts' owners and starts; cut between terms."""
    held, owner, size = [], [], 0
    for i, t in enumerate(texts):
        at, n = 0, len(t or b"")
        while at < n:
            end = min(n, at + CHUNK)
            while end < n and not _BETWEEN[t[end]]:  # a longer term is taken whole
                end += 1
            held.append(t[at:end])
            owner.append(i)
            size, at = size + end - at, end
            if size >= CHUNK:
                yield b"\n".join(held).lower(), np.array(owner), np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
                held, owner, size = [], [], 0
    if held:
        yield b"\n".join(held).lower(), np.array(owner), np.cumsum([0, *(len(x) + 1 for x in held[:-1])])


def _eights(buffer: bytes) -> np.ndarray:
    """The eight bytes from each byte on, as a number; zeros lie behind the end."""
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    return np.ndarray(len(buffer) + 1, "<u8", padded.data, strides=(1,))


class Dictionary:
    """Numbers of given terms, looked up by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]) -> None:
        h, start, end = _chunk_words(b"\n".join(terms), _BETWEEN)
        order = np.argsort(h)
        self.h, self.number, self.pool = h[order], order, b"\n".join(terms)
        self.start, self.size = start[order], (end - start)[order]
        if len(np.unique(h)) != len(terms):
            raise RuntimeError("two terms share a hash")
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(h >> np.uint64(44)).astype(np.intp)] = True

    def find(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first bytes of all terms in a buffer; of those in the dictionary, which they are, and their numbers."""
        h, start, end = _chunk_words(buffer, _BETWEEN)
        near = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.intp)])
        at = np.searchsorted(self.h, h[near])
        same = (at < len(self.h)) & (self.h.take(at, mode="clip") == h[near])
        near, at = near[same], at[same]
        size = (end - start)[near]
        ok = size == self.size[at]
        left, mine, own = np.flatnonzero(ok), _eights(buffer), _eights(self.pool)
        for j in range(0, int(size[left].max(initial=0)), 8):
            left = left[size[left] > j]
            differ = ((mine[start[near[left]] + j] ^ own[self.start[at[left]] + j]) & _MASK[np.minimum(size[left] - j, 8)]) != 0
            ok[left[differ]] = False
            left = left[~differ]
        return start, near[ok], self.number[at[ok]]


def distinct_terms(text: bytes | None) -> list[bytes]:
    out: set[bytes] = set()
    for buffer, _, _ in chunks([text]):
        out.update(buffer.translate(_CUT).split())
    return sorted(out)


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms) of each row, ``item`` being a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            found = [distinct_terms(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])

    kind = items.schema[item_col].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("t"))
    return stored(rows.mapInArrow(run, f"item long, item_id {kind}, terms array<binary>"))


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, times) of every row: all its terms with repeats, and the numbers in ``terms`` of those it holds."""
    told = docs.sparkSession.sparkContext.broadcast(terms)  # at most BLOCK_TERMS, or one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(told.value)
        for b in slices(batches, 1):
            n, keys = np.zeros(b.num_rows, np.int64), [np.zeros(0, np.int64)]
            for buffer, owner, edges in chunks(b.column(1).cast(pa.binary()).to_pylist()):
                start, which, number = known.find(buffer)
                of = owner[np.searchsorted(edges, start, "right") - 1]
                n += np.bincount(of, minlength=b.num_rows)
                keys.append(of[which] << 32 | number)
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            edges = pa.array(np.searchsorted(key, np.arange(b.num_rows + 1) << 32), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (key & 0xFFFFFFFF, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, times array<int>")


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit keys, by their low and then their high 16 bits, which NumPy sorts by radix."""
    low = np.argsort((key & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    return low[np.argsort((key >> np.uint32(16)).astype(np.uint16)[low], kind="stable")]


def accumulate(doc: np.ndarray, number: np.ndarray, impact: np.ndarray, first: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, sum) in that order, of postings whose term ``number`` is in items[first[number]:first[number + 1]]."""
    n = first[number + 1] - first[number]
    end = np.cumsum(n)
    each = np.repeat(np.arange(len(number)), n)
    at = np.arange(len(each)) + np.repeat(first[number] - (end - n), n)
    key = (items[at].astype(np.uint32) << np.uint32(DOC_BITS)) | doc[each].astype(np.uint32)
    order = radix_order(key)
    key, impact = key[order], impact[each][order]
    head = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint32(1))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(impact, head) if len(head) else np.zeros(0, np.int64)
    return (key[head] >> np.uint32(DOC_BITS)).astype(np.int64), (key[head] & np.uint32((1 << DOC_BITS) - 1)).astype(np.int64), total


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + 90 n N / L, rounded down."""
    if 90 * int(n.max(initial=0)) * n_docs >= 2**63:
        return np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 10 + 90 * n * n_docs // n_terms


def _best(spark: SparkSession, found: DataFrame, weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, stats: tuple[int, int], k: int) -> DataFrame:
    """(part, item, doc_id, score): the k best documents of each item in each range of documents."""
    told = spark.sparkContext.broadcast((weights, first, items))  # the block's terms, and the items of each
    span = np.diff(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        weights, first, items = told.value
        heaps: list[list] = [[] for _ in range(n_items)]
        least = np.zeros(n_items, np.int64)
        kind = None
        for b in batches:
            kind = b.column(0).type
            m = length_factor(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), *stats)
            edges = np.concatenate(([0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))))
            number, times = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            doc = np.repeat(np.arange(b.num_rows), np.diff(edges))
            impact = weights[number] * (1000000000 * times // (1000 * times + 8 * m[doc]))
            names = b.column(0).to_pylist()
            size = np.cumsum(np.add.reduceat(np.append(span[number], 0), edges[:-1]) * (np.diff(edges) > 0)) if b.num_rows else np.zeros(0, np.int64)
            lo = 0
            while lo < b.num_rows:
                before = int(size[lo - 1]) if lo else 0
                hi = min(max(lo + 1, int(np.searchsorted(size, before + ENTRIES, "right"))), lo + (1 << DOC_BITS), b.num_rows)
                own = slice(int(edges[lo]), int(edges[hi]))
                item, at, score = accumulate(doc[own] - lo, number[own], impact[own], first, items)
                for i, d, s in zip(*(x[(score > 0) & (score >= least[item])].tolist() for x in (item, at, score)), strict=True):
                    name = names[lo + d]
                    entry = (s, name is not None, -(name or 0))
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], entry)
                    elif entry > heaps[i][0]:
                        heapq.heapreplace(heaps[i], entry)
                    if len(heaps[i]) == k:
                        least[i] = heaps[i][0][0]
                lo = hi
        rows = [(i, -d if known else None, s) for i, heap in enumerate(heaps) for s, known, d in heap]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(item, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())], names=["part", "item", "doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.where(F.size("terms") > 0).mapInArrow(run, f"part int, item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, with scores above 0.

    Terms are runs of bytes other than ASCII signs, blanks and controls, with A-Z lower-cased; null and empty texts have
    none, and texts of any length are taken whole. With N documents that have a term, L terms, df documents that hold a
    term and tf times in a document of n terms, its weight is floor(1000 ln((2 N + 2) / (2 df + 1))), and it adds weight
    * (10^9 tf / (1000 tf + 8 (10 + 90 n N / L))), rounded down at each division. Equal scores go by ascending id, null
    last. Every row of ``items`` is an item and every row of ``docs`` a document, also with a repeated or null id (ids
    are integers). No documents, no items or no matches give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = _item_terms(items, item_col, item_text_col)
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-2 * n_terms // BLOCK_TERMS)) if n_terms > BLOCK_TERMS else 1
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((items, item_col), (docs, id_col))]
    schema = f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long"
    out, stats = [], None
    for block in range(n_blocks):
        rows = asked.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)).orderBy("item").collect()
        terms = sorted({bytes(t) for r in rows for t in r["terms"]})
        if not terms:
            continue
        at = {t: i for i, t in enumerate(terms)}
        pairs = np.array(sorted((at[bytes(t)], i) for i, r in enumerate(rows) for t in r["terms"]), np.int64)
        first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
        found = stored(postings(docs, terms, id_col, text_col))
        if stats is None:
            total = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
            stats = (total["docs"], total["terms"] or 0)
        weights = np.zeros(len(terms), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            weights[r["t"]] = math.floor(1000 * math.log((2 * stats[0] + 2) / (2 * r["df"] + 1)))
        best = _best(spark, found, weights, first, pairs[:, 1], len(rows), stats, k)
        out.append((stored(best), spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kinds[0]}")))
        discard(found)
    discard(asked)
    if not out:
        return spark.createDataFrame([], schema)
    ranked = [_ranked(best, names, k) for best, names in out]
    for x in ranked[1:]:
        ranked[0] = ranked[0].unionByName(x)
    return ranked[0]


def _ranked(best: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first within about the root of all ranges."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    n = best.agg(F.max("part")).first()[0] or 0
    group = F.pmod(F.col("part"), F.lit(max(1, math.isqrt(n + 1))))
    some = best.withColumn("g", group).withColumn("rank", F.row_number().over(Window.partitionBy("item", "g").orderBy(*order))).where(F.col("rank") <= k)
    rows = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
