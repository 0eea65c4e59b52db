"""Repeated passages by sparse suffix arrays.

Of all suffixes of a document those at minimiser positions are retained: places that the content selects, so that
copies of a passage select the same ones. Retained suffixes are sorted across all documents; of those that share
their head, every window of MIN_WORDS words around it is compared by its hash, within the sorted run or, where that is
long or cut by a partition's end, over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, mix, shingles, slices, stored, word_hashes

#: Words that a reported passage has at least.
MIN_WORDS = 50
#: A position is retained if the hash of its GRAM words is the least of WINDOW consecutive ones. A passage of
#: MIN_WORDS words has a retained position among its first WINDOW, so HEAD words of the passage follow it.
GRAM, WINDOW = 8, 24
HEAD = MIN_WORDS - WINDOW + 1
#: Words beyond the head, and before the position, by which a match is extended from one position. Passages longer
#: than that have several retained positions, whose matches overlap.
REACH = MIN_WORDS - HEAD
#: Contexts that are compared at once. Windows of longer runs of one head meet by their hashes.
RUN = 4096
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.iinfo(np.int64).max

_SUFFIX = "head long, doc_id long, text_key long, pos int"
_CONTEXT = "head long, right binary, left binary, doc_id long, text_key long, pos int, n_left int, n_right int"
_FOUND = "doc_id long, text_key long, start long, end long, match_doc long, window long"


def retained(words: np.ndarray) -> np.ndarray:
    """The minimiser positions that have HEAD words from there on."""
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64)
    g = shingles(words, GRAM)
    first = sliding_window_view(g, WINDOW).argmin(axis=1) + np.arange(len(g) - WINDOW + 1)
    at = np.unique(first)
    return at[at + HEAD <= len(words)]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 2):
        words, counts = word_hashes(b.column(2).to_pylist())
        ends = np.cumsum(counts)
        head, row, pos = [], [], []
        for i, (e, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            own = words[e - n : e]
            at = retained(own)
            if len(at):
                head.append(shingles(own, HEAD)[at])
                row.append(np.full(len(at), i))
                pos.append(at)
        if head:
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(head).view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(pos), pa.int32())], names=["head", "doc_id", "text_key", "pos"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes those that share their head with another document; runs at a batch's edges pass as well."""
    for b in batches:
        if not b.num_rows:
            continue
        head, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        start = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        size = np.diff(np.append(start, len(head)))
        several = np.repeat(np.maximum.reduceat(doc, start) != np.minimum.reduceat(doc, start), size)
        several |= (head == head[0]) | (head == head[-1])
        yield b.filter(pa.array(several))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each candidate position the words around: to the right beyond the head, to the left nearest first."""
    names = ["head", "right", "left", "doc_id", "text_key", "pos", "n_left", "n_right"]
    for b in slices(batches, 2):
        words, counts = word_hashes(b.column(2).to_pylist())
        ends = np.cumsum(counts)
        out: list[list] = [[] for _ in names]
        for i, spots in enumerate(b.column(3).to_pylist()):
            own = words[ends[i] - counts[i] : ends[i]]
            short = (own >> np.uint64(32)).astype(">u4")
            heads = shingles(own, HEAD).view(np.int64)
            for at in spots:
                right, left = short[at + HEAD : at + HEAD + REACH], short[max(0, at - REACH) : at][::-1]
                for c, x in zip(out, (int(heads[at]), right.tobytes().ljust(4 * REACH, b"\0"), left.tobytes().ljust(4 * REACH, b"\0"), b.column(0)[i].as_py(), b.column(1)[i].as_py(), at, len(left), len(right)), strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=names)


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... REACH words of each row."""
    out = np.zeros((len(words), REACH + 1), np.uint64)
    for i in range(REACH):
        out[:, i + 1] = out[:, i] * _STEP + words[:, i] + np.uint64(1)
    return mix(out)


def _windows(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of MIN_WORDS words that has the head in it, by its words left of the head; and which exist."""
    left, right = (_prefixes(np.frombuffer(b"".join(x[c].to_pylist()), ">u4").reshape(len(x), REACH).astype(np.uint64)) for c in ("left", "right"))
    k = np.arange(REACH + 1)
    ok = (k <= x["n_left"].to_numpy()[:, None]) & (REACH - k <= x["n_right"].to_numpy()[:, None])
    head = x["head"].to_numpy().view(np.uint64)[:, None]
    return mix(head + left * _LEFT + right[:, ::-1] * _RIGHT), ok


def _decide(x: pa.Table, unsure: np.ndarray) -> pa.RecordBatch:
    """Spans of windows that other documents of the table have as well.

    Of ``unsure`` rows, whose head others outside the table may share, windows are passed on by hash: each that is
    in one document here, and of the others the two least ids.
    """
    doc, key, pos = (x[c].to_numpy() for c in ("doc_id", "text_key", "pos"))
    hashes, ok = _windows(x)
    row, k = np.nonzero(ok)
    flat = hashes[ok]
    order = np.argsort(flat)
    row, k, flat = row[order], k[order], flat[order]
    kinds = (("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("match_doc", pa.int64()), ("window", pa.int64()))
    if not len(flat):
        return pa.RecordBatch.from_arrays([pa.array([], t) for _, t in kinds], names=[n for n, _ in kinds])
    d = doc[row]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    size = np.diff(np.append(first, len(flat)))
    least = np.minimum.reduceat(d, first)
    several = np.maximum.reduceat(d, first) != least
    other = np.minimum.reduceat(np.where(d == np.repeat(least, size), _NONE, d), first)
    # spans: stretches of windows, side by side, that are shared
    match = np.full((len(x), REACH + 3), _NONE)
    shared = np.zeros(match.shape, bool)
    shared[row, k + 1] = np.repeat(several, size)
    match[row, k + 1] = np.where(d == np.repeat(least, size), np.repeat(other, size), np.repeat(least, size))
    edge = np.flatnonzero(np.diff(shared.ravel()))  # before each stretch, and its last
    begin, last = edge[::2] + 1, edge[1::2]
    at, lo, hi = begin // shared.shape[1], begin % shared.shape[1] - 1, last % shared.shape[1] - 1
    best = np.minimum.reduceat(match.ravel(), np.stack([begin, last + 1], 1).ravel())[::2] if len(begin) else begin
    place = pos[at].astype(np.int64)
    # windows that are not decided here
    late = unsure[row] & ~np.repeat(several, size)
    told = np.flatnonzero(several & unsure[row[first]])
    ids = np.concatenate([d[late], least[told], other[told]])
    window = np.concatenate([flat[late], flat[first[told]], flat[first[told]]]).view(np.int64)
    start = (pos[row[late]] - k[late]).astype(np.int64)
    none = pa.nulls(2 * len(told), pa.int64())
    rest = pa.nulls(len(ids), pa.int64())
    parts = (
        (pa.array(doc[at]), pa.array(ids)),
        (pa.array(key[at]), pa.array(key[row[late]]), none),
        (pa.array(place - hi), pa.array(start), none),
        (pa.array(place - lo + MIN_WORDS), rest),
        (pa.array(best), rest),
        (pa.nulls(len(at), pa.int64()), pa.array(window)),
    )
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in parts], names=[n for n, _ in kinds])


def _compare(most: int):
    """Of sorted contexts the shared windows. Runs of one head that are longer than ``most``, and a partition's first
    and last run, are decided in part and their other windows passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        part: list[int] = []  # heads of runs that are not all in one table

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            x = pa.Table.from_batches(held).combine_chunks()
            head = x["head"].to_numpy()
            tail = int((head == head[-1]).argmax())
            if last or not tail:
                part.append(int(head[-1]))
                tail = len(x)
            now, x = x.slice(0, tail), x.slice(tail)
            yield _decide(now, np.isin(head[:tail], np.array(part)))
            del part[:-1]  # sorted: only the latest may go on
            held, count = x.to_batches(), len(x)

        for b in batches:
            if not b.num_rows:
                continue
            if not part:
                part.append(b.column(0)[0].as_py())
            held.append(b)
            count += b.num_rows
            if count >= most:
                yield from ready(False)
        if held:
            yield from ready(True)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's spans, overlapping ones as one."""
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        for d, k, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held = None
            for s in sorted((s["start"], s["end"], s["match_doc"]) for s in spans):
                if held and s[0] <= held[1]:
                    held = (held[0], max(held[1], s[1]), min(held[2], s[2]))
                    continue
                if held:
                    for c, v in zip(out, (d, k, *held), strict=True):
                        c.append(v)
                held = s
            for c, v in zip(out, (d, k, *held), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "text_key", "start", "end", "match_doc"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, match_doc): passages of MIN_WORDS words or more also in other documents.

    Words are runs without ASCII white space, A-Z lower-cased. Every document with such a passage is reported, the
    first one too; overlapping passages are one; ``match_doc`` is the smallest id among those that a
    passage was matched with. Repeats within one document don't count. Rows that share an id are one document (equal
    rows are reported once). Null ids, null, empty and shorter texts have no passage; no rows, no passages.
    """
    text = F.col(text_col)
    rows = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text) >= 2 * MIN_WORDS - 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("t"))
    order = ["head", "doc_id", "text_key", "pos"]
    suffixes = rows.mapInArrow(_suffixes, _SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order)
    spots = suffixes.mapInArrow(_repeated, _SUFFIX).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("spots"))
    around = rows.join(spots, ["doc_id", "text_key"]).select("doc_id", "text_key", "t", "spots").mapInArrow(_contexts, _CONTEXT)
    order = ["head", "right", "left", "doc_id", "text_key", "pos"]
    found = stored(around.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare(run), _FOUND))
    late = found.where(F.col("window").isNotNull())
    known = late.groupBy("window").agg(F.array_sort(F.collect_set("doc_id")).alias("docs")).where(F.size("docs") > 1)
    other = F.when(F.col("docs")[0] == F.col("doc_id"), F.col("docs")[1]).otherwise(F.col("docs")[0])
    late = late.where(F.col("start").isNotNull()).join(known, "window").select("doc_id", "text_key", "start", (F.col("start") + MIN_WORDS).alias("end"), other.alias("match_doc"))
    spans = found.where(F.col("window").isNull()).select("doc_id", "text_key", "start", "end", "match_doc").unionByName(late)
    per = spans.distinct().groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end", "match_doc")).alias("spans"))
    merged = per.mapInArrow(_merge, "doc_id long, text_key long, start long, end long, match_doc long")
    return merged.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "match_doc")
