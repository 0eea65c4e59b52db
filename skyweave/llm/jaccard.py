"""Exact n-gram Jaccard join with set-relation skipping.

Equal sets are one class. The sets' shingles are put in one global order, rare ones first (counts of all documents,
in a table of fixed size). Sets that share a minimum hash are compared with a pivot, the one with the fewest rare
shingles; a set that links to its pivot takes over the pivot's component, and needs no comparison with the sets in
it. Index lists of the prefix shingles then yield what is left: a list's entries lie in blocks by position, blocks
and runs of blocks that can't reach the overlap are skipped, and pairs whose components are known to be one are
skipped. Every candidate is verified with whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, free_name, mix, shingles, slices, stored, word_hashes
from .components import PIECES, components, with_least

WORDS = 4
#: Sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Slots of the table of shingle counts (its size bound: 4 bytes each), sent in chunks.
SLOTS = 1 << 21
_CHUNK = 1 << 15
#: Minimum hashes by which a set meets pivots.
PIVOTS = 4
_SEEDS = np.random.default_rng(5).integers(1, 1 << 62, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: list, w: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return [np.unique(shingles(words[e - n : e], w)) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(x) for x in np.array([mix(s).sum(dtype=np.uint64), mix(s * _SEEDS[0]).sum(dtype=np.uint64)], np.uint64).view(np.int64)) if len(s) else (0, 0)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(SLOTS - 1)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """Two sets of which one has n shingles can't link unless they share one of its first so many."""
    return n - -(-percent * n // 100) + 1


def _describe(w: int):
    """Of every document the size and signature of its set; of every partition its counts of shingle slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sig1", "sig2", "chunk", "counts"]
        seen = np.zeros(SLOTS, np.uint32)
        for b in slices(batches, 1):
            sets = _sets(b.column(1).to_pylist(), w)
            sig = [_signature(s) for s in sets]
            for s in sets:
                seen[_slot(s)] += 1  # distinct shingles of one set that share a slot count once
            nothing = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in sig], pa.int64()), pa.array([x for _, x in sig], pa.int64()), *nothing], names=names)
        used = [c for c in range(SLOTS // _CHUNK) if seen[c * _CHUNK : (c + 1) * _CHUNK].any()]
        none = [pa.nulls(len(used), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), pa.array([seen[c * _CHUNK : (c + 1) * _CHUNK].tobytes() for c in used], pa.binary())], names=names)

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[c] = total.get(c, 0) + np.frombuffer(x, np.uint32).astype(np.uint64)
    out = [np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "counts"])


def _prefixes(w: int, percent: int, told):
    """Of every document its minimum hashes, how many rare shingles it has, and its prefix in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = told.value
        rare = max(4, 2 * int(np.median(counts)))
        for b in slices(batches, 1):
            mins, few, prefix, n, sig = [], [], [], [], []
            for s in _sets(b.column(1).to_pylist(), w):
                c = counts[_slot(s)]
                order = np.lexsort((s, c))[: prefix_length(len(s), percent)]
                prefix.append(s[order].view(np.int64))
                with np.errstate(over="ignore"):
                    mins.append([int(x) for x in np.array([mix(s * k).min() for k in _SEEDS], np.uint64).view(np.int64)] if len(s) else [])
                few.append(int((c <= rare).sum()))
                n.append(len(s))
                sig.append(_signature(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([x for x, _ in sig], pa.int64()), pa.array([x for _, x in sig], pa.int64()), pa.array(few, pa.int64()), pa.array(mins, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "n", "sig1", "sig2", "rare", "mins", "prefix"])

    return run


def _list_pairs(comp: np.ndarray, doc: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[list, list]:
    """Pairs of one index list that may link, over different components. Entries come sorted by size.

    A link needs an overlap of percent / (100 + percent) of both sizes together. With the first shared shingle at
    positions i and j, no more than min(n_a - i, n_b - j) can be shared, which leaves each block of equal j one run
    of sizes; the rest of the block is skipped.
    """
    left, right = [], []
    blocks = [(int(j), np.flatnonzero(pos == j)) for j in np.unique(pos)]
    for a in range(len(doc)):
        na, i = int(n[a]), int(pos[a])
        for j, block in blocks:
            sizes = n[block]
            lo = max(-(-percent * na // 100), -(-((100 + percent) * j + percent * na) // 100), na)  # each pair from its smaller set
            hi = min(100 * na // percent, ((100 + percent) * (na - i)) // percent - na)
            if hi < lo:
                continue
            part = block[np.searchsorted(sizes, lo, "left") : np.searchsorted(sizes, hi, "right")]
            part = part[(comp[part] != comp[a]) & ((n[part] > na) | (doc[part] > doc[a]))]
            left += [int(doc[a])] * len(part)
            right += doc[part].tolist()
    return left, right


def _lists(percent: int):
    """Over postings sorted by shingle and size: the candidate pairs of each index list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pairs(x: np.ndarray) -> pa.RecordBatch:
            left, right = [], []
            cuts = np.flatnonzero(np.concatenate(([True], x[1:, 0] != x[:-1, 0], [True])))
            most, least = np.maximum.reduceat(x[:, 1], cuts[:-1]), np.minimum.reduceat(x[:, 1], cuts[:-1])
            for k in np.flatnonzero(most != least):  # a list within one component has its answers
                own = x[cuts[k] : cuts[k + 1]]
                a, b = _list_pairs(own[:, 1], own[:, 2], own[:, 3] >> 32, own[:, 3] & 0xFFFFFFFF, percent)
                left += a
                right += b
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(i).to_numpy() for i in range(4)], 1)
            held.append(x)
            if x[0, 0] == x[-1, 0] == held[0][0, 0]:
                continue  # one list so far
            x = np.concatenate(held)
            last = int(np.searchsorted(x[:, 0], x[-1, 0], "left"))
            yield pairs(x[:last])
            held = [x[last:]]
        if held:
            yield pairs(np.concatenate(held))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, w: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of document ids, those that link; sets are built again for the documents concerned."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bits = 24
    told = spark.sparkContext.broadcast(bit_filter(ids, "id", bits))
    slot = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << bits) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = told.value
        for b in slices(batches, 1):
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in _sets(b.column(1).to_pylist(), w)], pa.list_(pa.int64()))], names=["doc_id", "s"])

    sets = docs.select("doc_id", "t", slot.alias("slot")).mapInArrow(run, "doc_id long, s array<long>").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    # a pivot may be in very many pairs: they are spread over tasks, each of which gets the pivot's set
    spread = pairs.withColumn("piece", F.pmod(F.xxhash64("a"), F.lit(PIECES)))
    two = spread.select("b", "piece").distinct().join(two, "b")
    return spread.join(one, "a").join(two, ["b", "piece"]).where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components_by_jaccard(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: linked documents share the smallest id they reach.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a shingle has is one
    shingle; a text without words, empty or null has none and links with nothing. Rows that share an id are one
    document, linked by any of their texts. Rows with a null id link with nothing and have a null component. An
    empty table gives no rows. Repeated links count once; equal sets are always linked.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    known = stored(rows.mapInArrow(_describe(words), "doc_id long, n long, sig1 long, sig2 long, chunk int, counts binary"))
    counts = np.zeros(SLOTS, np.uint32)
    sums = known.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition("chunk").mapInArrow(_sum_counts, "chunk int, counts binary")
    for r in sums.toLocalIterator():
        counts[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], np.uint32)
    told = spark.sparkContext.broadcast(counts)

    sized = known.where(F.col("chunk").isNull()).select("doc_id", "n", "sig1", "sig2")
    some = sized.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = cut(some.groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("rep")))
    live = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("t") > 0))
    described = live.mapInArrow(_prefixes(words, percent, told), "doc_id long, n long, sig1 long, sig2 long, rare long, mins array<long>, prefix array<long>")
    reps = stored(described.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "sig1", "sig2"], "left_semi").dropDuplicates(["doc_id", "n", "sig1", "sig2"]).select("doc_id", "n", "rare", "mins", "prefix"))

    # Answers by relation: each set with the pivot of the buckets it is in.
    met = reps.select("doc_id", "n", "rare", F.posexplode("mins").alias("k", "low"))
    met = with_least(met, ["k", "low"], "doc_id", F.struct("rare", F.col("doc_id").alias("id"), F.col("n").alias("m"))).withColumnRenamed("least", "p")
    near = met.where((F.col("count") > 1) & (F.col("doc_id") != F.col("p.id")) & (100 * F.least("n", "p.m") >= percent * F.greatest("n", "p.m")))
    near = cut(near.select(F.col("doc_id").alias("a"), F.col("p.id").alias("b")).distinct())
    first = cut(_verified(live, near, words, percent))
    # rows that share an id are one document; so are equal sets
    copies = some.join(classes, ["n", "sig1", "sig2"]).where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    known_comp = cut(components(first))

    # What is left: index lists of prefixes, over components.
    p = reps.join(known_comp, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"), "n", F.posexplode("prefix").alias("pos", "token"))
    postings = p.select("token", "comp", "doc_id", F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("meta"))
    left = cut(postings.repartition("token").sortWithinPartitions("token", "meta", "doc_id").mapInArrow(_lists(percent), "a long, b long").distinct())
    second = cut(_verified(live, left, words, percent))

    linked = components(first.unionByName(second).unionByName(copies))
    return sized.join(linked, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for documents linked with one of a smaller id; rows with a null id are kept.

    Of rows that share an id each is kept; of a component the document with the smallest id stays.
    """
    c = components_by_jaccard(docs, words, percent, id_col, text_col)
    name = free_name(docs, "__gone")
    gone = c.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
