"""Quality: a logistic regression of hashed word n-grams, trained with follow-the-regularised-leader updates.

Two streams of n-grams are hashed into one space: of the words themselves, and of the words' forms (case, digits,
length, last mark, whether the word came before in the text), which tell junk of any vocabulary. A feature's value
is its share of the text's n-grams, and a score is the sparse dot product of values and weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _CHUNK, _SPACE, labelled_rows, map_text, mix, word_hashes

BITS = 18
WORD_SIZES = (1, 2)
FORM_SIZES = (1, 2, 3)
#: Rows of labelled text to learn from, at most (about, by a hash of the id), dealt to so many learners.
TRAIN_ROWS = 12_000
LEARNERS = 4
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.02
#: Values are shares of a text times this.
SCALE = 8.0
THRESHOLD = 0.7


def _forms(text: bytes) -> np.ndarray:
    """A small number for each word's form; the text is read in chunks cut at white space."""
    out, at = [], 0
    while at < len(text):
        end = at + _CHUNK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        b = np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)
        at = end
        edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            continue

        def share(mask: np.ndarray, start=start, stop=stop) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[stop] - total[start]

        n = stop - start
        upper, lower, digit = share((b >= 65) & (b <= 90)), share(((b >= 97) & (b <= 122)) | (b >= 128)), share((b >= 48) & (b <= 57))
        case = np.where(upper + lower == 0, 0, np.where(upper == 0, 1, np.where((upper == 1) & (b[start] >= 65) & (b[start] <= 90), 2, np.where(lower == 0, 3, 4))))
        last = b[stop - 1].astype(np.int64)
        mark = np.where((last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 128)), last, 0)
        first = b[start].astype(np.int64)
        lead = np.where((first < 48) | ((first > 57) & (first < 65)) | ((first > 90) & (first < 97)) | ((first > 122) & (first < 128)), first, 0)
        size = np.minimum(np.log2(n).astype(np.int64), 6)
        out.append((((case * 128 + mark) * 128 + lead) * 8 + size) * 2 + (digit > 0))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _grams(h: np.ndarray, sizes: tuple, salt: int) -> list[np.ndarray]:
    out = []
    for k in sizes:
        if len(h) >= k:
            g = np.full(len(h) - k + 1, salt * 16 + k, np.uint64)
            for i in range(k):
                g = g * np.uint64(0xD6E8FEB86659FD93) + h[i : len(g) + i]
            out.append((mix(g) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def features(texts: list[str | None]) -> list[list[np.ndarray]]:
    """For each text, arrays of hashed n-grams, one for each stream and size."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, counts = word_hashes(raw)
    ends = np.cumsum(counts)
    found = []
    for t, e, n in zip(raw, ends.tolist(), counts.tolist(), strict=True):
        h = words[e - n : e]
        again = np.ones(n, np.uint64)
        if n:
            again[np.unique(h, return_index=True)[1]] = 0
        forms = _forms(t).astype(np.uint64) * np.uint64(2) + again
        found.append(_grams(h, WORD_SIZES, 1) + _grams(mix(forms + np.uint64(1)), FORM_SIZES, 2))
    return found


def _values(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and values."""
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0)
    i = np.concatenate(grams)
    v = np.concatenate([np.full(len(g), SCALE / len(g)) for g in grams])
    at, back = np.unique(i, return_inverse=True)
    return at, np.bincount(back, v)


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    """Follow the regularised leader over one learner's rows, in the order of a hash."""
    rows = rows.sort_values(["r", "k"], kind="stable")
    data = [(*_values(g), int(y)) for g, y in zip(features(rows.t.tolist()), rows.y.tolist(), strict=True)]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(PASSES):
        for at, v, y in data:
            at, v = np.append(at, 1 << BITS), np.append(v, 1.0)  # the bias
            w = _leader(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = (p - y) * v
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = _leader(z, n)
    at = np.flatnonzero(w)
    return pd.DataFrame({"f": at, "w": w[at]})


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", key: str = "doc_id", max_rows: int = TRAIN_ROWS) -> dict:
    """Weights, the mean of the learners', from documents and their labels (0 or 1; null labels teach nothing).

    A learner holds about ``max_rows / LEARNERS`` rows; the driver gets at most 2 ** BITS + 1 weights. Without
    labelled rows all scores are 0.5.
    """
    rows = labelled_rows(docs, labels, label_col, max_rows, key, text_col).withColumn("t", F.coalesce("t", F.lit(""))).withColumn("r", F.xxhash64("k", "t")).withColumn("learner", F.pmod("r", F.lit(LEARNERS)))
    learners = rows.select("learner").distinct().count()
    w = np.zeros((1 << BITS) + 1)
    if learners:
        got = rows.groupBy("learner").applyInPandas(_learn, "f long, w double").groupBy("f").agg(F.sum("w").alias("w")).toPandas()
        w[got.f.to_numpy(np.int64)] = got.w.to_numpy() / learners
    return {"w": w[:-1].astype(np.float32), "bias": float(w[-1])}


def predict(model: dict, texts: list[str | None]) -> np.ndarray:
    w = model["w"]
    z = np.array([sum(SCALE * float(w[g].mean(dtype=np.float64)) for g in grams) for grams in features(texts)]) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, score_as: str = "score") -> DataFrame:
    """The rows of ``docs`` with the quality of the whole text, from 0 to 1.

    Null and empty texts have no feature and get the bias's score. A column named like the output is replaced;
    equal texts get equal scores; no rows, no scores.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: list) -> dict:
        return {score_as: predict(told.value, texts)}

    return map_text(docs, text_col, fn, [T.StructField(score_as, T.DoubleType())], keep)
