"""Benchmark decontamination by spaced seeds.

A mask marks the token positions that a seed hashes; the others are ignored, so that a seed survives substitutions
there. Seeds of the benchmark and of the documents are joined by hash inside the scan, against blocks of the
benchmark of bounded size, and every hit is verified: aligned at the hit, a window of the item must agree with the
document in at least ``MIN_MATCH`` of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_text, mix, slices, word_hashes

#: Token positions that seeds hash. Seven masks of weight five; short windows that they don't cover get their own.
MASKS = ("11111", "110111", "1101011", "10110011", "11001101", "101010011", "1100101001")
#: An item's window, in tokens, and the share of its tokens that must agree.
WINDOW = 50
MIN_MATCH = 0.8
#: Bytes of benchmark text in one broadcast block. A larger benchmark takes more blocks, each a pass over the documents.
BLOCK_BYTES = 8 << 20
#: Pairs of a seed in a text and one in an item that are laid out at a time.
PAIRS = 1 << 18
_BITS = 24
_FACTORS = np.random.default_rng(77).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def folded(col: str) -> Column:
    """Text without case, in letters of any script: one upper-case letter for all that share it."""
    return F.upper(F.lower(F.col(col)))


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Seed hash at every position at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i, (at, bit) in enumerate((j, b) for j, b in enumerate(mask) if b == "1"):
        h += words[at : at + n] * _FACTORS[i]
    return mix(h + np.uint64(len(mask)))


@cache
def _masks(n: int, least: int) -> tuple[str, ...]:
    """Masks for windows of ``n`` tokens: the given ones, or for short windows that can agree in ``least`` tokens
    without agreeing in one of those, all choices of so many tokens."""
    fit = tuple(m for m in MASKS if len(m) <= n)
    if n >= max(map(len, MASKS)):
        return fit
    placed = [{a + j for j, c in enumerate(m) if c == "1"} for m in fit for a in range(n - len(m) + 1)]
    kept = list(combinations(range(n), max(1, least)))
    if all(any(p <= set(k) for p in placed) for k in kept):
        return fit
    return tuple({"".join("1" if i in k else "0" for i in range(n)).strip("0") for k in kept})


def _index(items: list[tuple[int, bytes]], window: int, min_match: float) -> dict | None:
    """Sorted seeds of a block of items, and the items' tokens."""
    words, counts = word_hashes([t for _, t in items])
    ends = np.cumsum(counts)
    seeds, owner, offset, masks = [], [], [], set()
    for i, n in enumerate(counts.tolist()):
        own = words[ends[i] - n : ends[i]]
        length = min(window, n)
        for m in _masks(length, ceil(min_match * length)) if n else ():
            masks.add(m)
            s = _seeds(own, m)
            seeds.append(s)
            owner.append(np.full(len(s), i))
            offset.append(np.arange(len(s)))
    if not seeds:
        return None
    seed, own, at = map(np.concatenate, (seeds, owner, offset))
    order = np.argsort(seed, kind="stable")
    bits = np.zeros(1 << _BITS, bool)
    bits[(seed >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return {"seed": seed[order], "item": own[order], "at": at[order], "bits": np.packbits(bits), "masks": sorted(masks, key=lambda m: (len(m), m)), "words": words, "start": ends - counts, "n": counts, "id": np.array([i for i, _ in items])}


def _best_window(doc: np.ndarray, item: np.ndarray, diagonal: int, window: int) -> tuple[int, int, int]:
    """Most agreeing tokens in a window of the item laid on the document: (agreeing, first item token, length)."""
    n = len(item)
    lo, hi = max(0, -diagonal), min(n, len(doc) - diagonal)
    same = np.zeros(n + 1, np.int64)
    if hi > lo:
        same[lo + 1 : hi + 1] = doc[diagonal + lo : diagonal + hi] == item[lo:hi]
    total = np.cumsum(same)
    length = min(window, n)
    got = total[length:] - total[: n + 1 - length]
    at = int(got.argmax())
    return int(got[at]), at, length


def _hits(x: dict, texts: list[bytes | None], window: int, min_match: float) -> Iterator[tuple[int, ...]]:
    """(text, item, start, item_start, n_tokens, n_match) of an index's items in texts."""
    bits = np.unpackbits(x["bits"]).astype(bool)
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    first = ends - counts
    doc_of = np.repeat(np.arange(len(texts)), counts)
    n_items, longest = len(x["n"]), int(x["n"].max(initial=0))
    span = int(counts.max(initial=0)) + longest + 1
    if len(texts) * n_items * span >= 2**63:
        raise OverflowError("too many texts, items and words at once")
    found = np.zeros(0, np.int64)  # (text, item, diagonal), each once
    for m in x["masks"]:
        s = _seeds(words, m)
        at = np.flatnonzero(bits[(s >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = at[doc_of[at] == doc_of[at + len(m) - 1]]
        lo = np.searchsorted(x["seed"], s[at], "left")
        n = np.searchsorted(x["seed"], s[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        upto = np.cumsum(n)
        edges = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]) if len(upto) else 0, PAIRS))).tolist() + [len(n)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):  # text that repeats an item's seeds has very many pairs of few diagonals
            each = np.repeat(np.arange(i, j), n[i:j])
            k = lo[each] + np.arange(len(each)) - (upto[each] - n[each] - (upto[i] - n[i]))
            d = doc_of[at[each]]
            found = np.union1d(found, (d * n_items + x["item"][k]) * span + (at[each] - first[d] - x["at"][k] + longest))
    for key in found.tolist():
        pair, diagonal = divmod(key, span)
        d, i = divmod(pair, n_items)
        diagonal -= longest
        item = x["words"][x["start"][i] : x["start"][i] + x["n"][i]]
        got, at, length = _best_window(words[first[d] : ends[d]], item, diagonal, window)
        if got >= min_match * length:
            yield d, int(x["id"][i]), diagonal + at, at, length, got


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, window: int, min_match: float) -> Iterator[Broadcast]:
    """Indexes of the benchmark's blocks."""
    items = benchmark.where(F.col(item_col).isNotNull() & (F.octet_length(item_text) > 0)).select(F.col(item_col).cast("long").alias("i"), folded(item_text).cast("binary").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        index = _index([(r["i"], bytes(r["t"])) for r in block], window, min_match)
        if index is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(index)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_match: float = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, start, item_start, n_tokens, n_match): windows of benchmark items found in documents.

    Tokens are runs without ASCII white space; the case of letters, of any script, doesn't count. One row for each row
    of ``docs``, item and alignment in which the item's best window of ``window`` tokens (the whole item, if shorter)
    agrees in ``min_match`` of them. None is missed in windows below 31 tokens at the default, by enumeration, and below
    10 at any ``min_match``; of others those are found that agree in all tokens of a mask. ``start`` is the document
    token at which that window begins. Null and empty texts, and null item ids, match nothing; rows with a null document
    id are reported with it. Equal rows are reported each.
    """
    spark = docs.sparkSession
    rows = docs.where(F.octet_length(text_col) > 0).select(F.col(id_col).cast("long").alias("d"), folded(text_col).cast("binary").alias("t"))
    schema = "doc_id long, item_id long, start long, item_start long, n_tokens long, n_match long"

    def scan(told):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 1):
                ids = b.column(0)
                out = [(ids[d].as_py(), *rest) for d, *rest in _hits(told.value, b.column(1).to_pylist(), window, min_match)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], names=["doc_id", "item_id", "start", "item_start", "n_tokens", "n_match"])

        return run

    found = None
    for told in _blocks(benchmark, item_col, item_text, window, min_match):
        got = rows.mapInArrow(scan(told), schema)
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_match: float = MIN_MATCH) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item.

    Each row is judged by its own text, whatever its id: one that shares its id with a contaminated row stays, and a
    contaminated row with a null id goes.
    """
    text, bad = free_name(docs, "__folded"), free_name(docs, "__bad")

    def marks(told):
        def fn(texts: list) -> dict:
            out = np.zeros(len(texts), bool)
            out[[d for d, *_ in _hits(told.value, texts, window, min_match)]] = True
            return {bad: out}

        return fn

    left = docs.withColumn(text, folded(text_col).cast("binary"))
    for told in _blocks(benchmark, item_col, item_text, window, min_match):
        marked = map_text(left, text, marks(told), [T.StructField(bad, T.BooleanType())], [*docs.columns, text])
        left = marked.where(~F.col(bad)).drop(bad)
    return left.drop(text)
