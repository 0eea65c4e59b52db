"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter for all languages: a slot is a word with a bit for each language, and further words beyond 64 languages.
The AND of an n-gram's slots gives, in one look-up, the mask of all languages that contain it. A text's mask bits are
counted by language, corrected for the share of n-grams that a language's bits let through by chance, and the largest
count decides.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, map_text, mix, slices

SIZES = (3, 4)
#: Rows of labelled text that the filter is built from, at most (about, by a hash of the id).
TRAIN_ROWS = 20_000
#: An n-gram belongs to a language if it makes up so much of its n-grams: at most 1 / MIN_SHARE n-grams each.
MIN_SHARE = 2e-5
#: Slots a contained n-gram, and look-ups.
SLOTS_PER_GRAM = 12
LOOKUPS = 3
#: Languages of one table of the filter, a bit each; more languages take more tables.
TABLE_LANGUAGES = 64
UNKNOWN = "und"
_CHARS = 1 << 18
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, with one space for all that lies between; and each text's place."""
    parts, lengths = [], []
    for t in texts:
        a = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = _LETTER[np.minimum(a, len(_LETTER) - 1)]
        a = np.where(ok, a, np.uint32(32))
        keep = ok.copy()
        keep[1:] |= ok[:-1]  # a space behind each word
        a = a[keep]
        if len(a):
            a = np.concatenate((np.array([32], np.uint32), a, np.array([32] if a[-1] != 32 else [], np.uint32)))
        parts.append(a)
        lengths.append(len(a))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate(([0], np.cumsum(lengths)))


def _grams(chars: np.ndarray, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of one size within texts, and the text of each."""
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x100000001B3) + chars[i : n + i]
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    inside = owner[:n] == owner[size - 1 :]
    return mix(h[inside]), owner[:n][inside]


def _runs(texts: list):
    """Ranges of texts of about _CHARS characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHARS or i + 1 == len(texts):
            yield at, i + 1
            at, size = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for lo, hi in _runs(own):
                chars, edges = _letters(own[lo:hi])
                gram, n = np.unique(np.concatenate([_grams(chars, edges, k)[0] for k in SIZES]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(LOOKUPS)]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", max_rows: int = TRAIN_ROWS) -> dict:
    """The filter, from rows of text and language; rows with a null text or language teach nothing.

    Built from about ``max_rows`` rows at most. What reaches the driver is bounded by 1 / MIN_SHARE n-grams for
    each language, 8 bytes each. Without labelled rows the filter has no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(key).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    rows = bounded_sample(rows, max_rows, "k").where(F.col("t").isNotNull())
    counted = rows.select("lang", "t").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    least = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = {r["lang"]: r["total"] for r in least.orderBy(F.desc("total"), "lang").collect()}
    langs = sorted(totals)
    per = {x: array("q") for x in langs}
    for r in counted.join(F.broadcast(least), "lang").where(F.col("n") >= F.greatest(F.lit(2.0), F.lit(MIN_SHARE) * F.col("total"))).select("lang", "gram").toLocalIterator():
        per[r["lang"]].append(r["gram"])
    counted.unpersist()
    size = 1 << max(10, int(np.ceil(np.log2(SLOTS_PER_GRAM * max([1, *map(len, per.values())])))))
    kind = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint64
    tables, passed = [], []
    for at in range(0, len(langs), TABLE_LANGUAGES):
        table = np.zeros(size, kind)
        own = langs[at : at + TABLE_LANGUAGES]
        for i, lang in enumerate(own):
            bit = np.zeros(size, bool)
            for s in _slots(np.array(per[lang], np.int64).view(np.uint64), size):
                bit[s] = True
            table[bit] |= kind(1 << i)
        passed += [float((table >> kind(i) & kind(1)).mean()) ** LOOKUPS for i in range(len(own))]
        tables.append(table)
    return {"langs": langs, "tables": tables, "by_chance": passed, "default": max(totals, key=totals.get) if totals else UNKNOWN}


def predict(model: dict, texts: list[str | None]) -> dict:
    """lang_pred and score of each text; see ``identify``."""
    langs, tables, by_chance = model["langs"], model["tables"], np.array(model["by_chance"])
    names, scores = [], []
    for lo, hi in _runs(texts):
        own = texts[lo:hi]
        chars, edges = _letters(own)
        seen = np.zeros(len(own))
        count = np.zeros((len(langs), len(own)))
        for k in SIZES:
            h, owner = _grams(chars, edges, k)
            seen += np.bincount(owner, minlength=len(own))
            for j, table in enumerate(tables):
                mask = None
                for s in _slots(h, len(table)):
                    mask = table[s] if mask is None else mask & table[s]
                at = j * TABLE_LANGUAGES
                for i in range(len(langs[at : at + TABLE_LANGUAGES])):
                    count[at + i] += np.bincount(owner, (mask >> table.dtype.type(i)) & table.dtype.type(1), len(own))
        empty = np.diff(edges) == 0
        for j in range(len(own)):
            if empty[j] or not langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            share = np.clip((count[:, j] / max(1, seen[j]) - by_chance) / np.maximum(1e-9, 1 - by_chance), 0, 1)
            best = int(share.argmax())
            names.append(langs[best] if share[best] > 0 else model["default"])
            scores.append(float(share[best] / share.sum()) if share[best] > 0 else 0.0)
    return {"lang_pred": names, "score": np.array(scores)}


def identify(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The rows of ``docs`` with the predicted language of the whole text and a score from 0 to 1.

    ``und`` with score 0 for a null text, one without a letter, and a model without languages; a text of which no
    n-gram is known gets the most frequent training language with score 0. Ties go to the first language by name.
    Columns named like the two outputs are replaced; equal rows get equal answers; no rows, no answers.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    out = [T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())]

    def fn(texts: list) -> dict:
        got = predict(told.value, texts)
        return {lang_as: got["lang_pred"], score_as: got["score"]}

    return map_text(docs, text_col, fn, out, keep)
