"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram in a text. Its log-count ratio compares how many toxic and how many
other training texts have it; a logistic regression is trained on the features scaled by these ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_rows, map_text, mix, slices

SIZES = (4, 5, 6)
BITS = 20
#: Rows of labelled text to learn from, at most (about, by a hash of the id).
TRAIN_ROWS = 20_000
#: Features with the strongest evidence that the regression sees; the others keep a weight of 0.
FEATURES = 1 << 12
SMOOTH = 1.0
RIDGE = 5e-5
STEPS = 400
THRESHOLD = 0.3
_CHARS = 1 << 18


def _codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with white space as single spaces, one at either end."""
    t = " ".join((text or "").lower().split())
    return np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32) if t else np.zeros(0, np.uint32)


def features(text: str | None, mark: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text, found in runs of bounded size.

    ``mark`` has a slot for each feature; the last occurrence to write its number there stands for the feature.
    """
    a = _codes(text)
    out = []
    for at in range(0, len(a), _CHARS):
        part = a[at : at + _CHARS + max(SIZES) - 1]
        h = np.zeros(len(part), np.uint64)
        found = []
        for k in range(1, max(SIZES) + 1):
            if len(part) < k:
                break
            h = h[: len(part) - k + 1] * np.uint64(0x100000001B3) + part[k - 1 :]
            if k in SIZES:
                found.append((mix(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
        if found:
            i = np.concatenate(found)
            n = np.arange(len(i), dtype=mark.dtype)
            mark[i] = n
            out.append(i[mark[i] == n])
    if len(out) > 1:
        return np.unique(np.concatenate(out))
    return out[0] if out else np.zeros(0, np.int64)


def _mark() -> np.ndarray:
    return np.zeros(1 << BITS, np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts that have each feature, by label, of this partition."""
    mark, seen = _mark(), np.zeros((2, 1 << BITS), np.int64)
    for b in slices(batches, 1):
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[y, features(t, mark)] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["f", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", key: str = "doc_id", max_rows: int = TRAIN_ROWS) -> dict:
    """Weights of the features and the bias, from documents and their labels (0 or 1; null labels teach nothing).

    The driver gets FEATURES log-count ratios at most, and two bytes for each chosen feature of about ``max_rows``
    rows. With one label only, or no row, the bias alone answers.
    """
    spark = docs.sparkSession
    rows = labelled_rows(docs, labels, label_col, max_rows, key, text_col).select("y", "t")
    y_n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = y_n.get(0, 0), y_n.get(1, 0)
    w = np.zeros(1 << BITS, np.float32)
    bias = float(np.log((n1 + SMOOTH) / (n0 + SMOOTH)))
    if not n0 or not n1:
        return {"w": w, "bias": bias}
    counted = rows.mapInArrow(_count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") > 2)
    c0, c1 = F.col("n0"), F.col("n1")
    p = (c0 + c1 + SMOOTH) / (n0 + n1 + 2 * SMOOTH)
    evidence = F.abs(c1 / n1 - c0 / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    ratio = F.log((c1 + SMOOTH) / (n1 + 2 * SMOOTH) / ((c0 + SMOOTH) / (n0 + 2 * SMOOTH)))
    best = counted.select("f", evidence.alias("evidence"), ratio.alias("ratio")).where("evidence > 3").orderBy(F.desc("evidence"), "f").limit(FEATURES).toArrow().sort_by("f")
    f, ratio = best["f"].to_numpy(), best["ratio"].to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[f] = np.arange(len(f))
    told = spark.sparkContext.broadcast(place)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = _mark()
        for b in slices(batches, 1):
            got = [told.value[features(t, mark)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.sort(x[x >= 0]).astype("<u2").tobytes() for x in got], pa.binary())], names=["y", "x"])

    data = rows.mapInArrow(chosen, "y int, x binary").groupBy("y", "x").count().toArrow().sort_by([("y", "ascending"), ("x", "ascending")])
    y, weight, x = data["y"].to_numpy().astype(float), data["count"].to_numpy().astype(float), data["x"].to_pylist()
    owner = np.repeat(np.arange(len(x)), [len(b) // 2 for b in x])
    col = np.frombuffer(b"".join(x), "<u2").astype(np.int64)
    w[f], bias = _regress(y, weight / weight.sum(), owner, col, ratio, bias)
    return {"w": w, "bias": float(bias)}


def _regress(y: np.ndarray, weight: np.ndarray, owner: np.ndarray, col: np.ndarray, ratio: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on features scaled by their ratios, by accelerated gradient steps."""
    scale = ratio[col]
    norm = np.bincount(owner, scale**2, len(y))
    step = 1 / (0.25 * (float((weight * norm).sum()) + 1) + RIDGE)
    u = v = np.zeros(len(ratio) + 1)
    u[-1] = bias
    for k in range(STEPS):
        z = np.bincount(owner, v[col] * scale, len(y)) + v[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(col, g[owner] * scale, len(ratio)) + RIDGE * v[:-1], g.sum())
        new = v - step * grad
        v = new + k / (k + 3) * (new - u)
        u = new
    return (u[:-1] * ratio).astype(np.float32), float(u[-1])


def predict(model: dict, texts: list[str | None], mark: np.ndarray | None = None) -> np.ndarray:
    mark = _mark() if mark is None else mark
    z = np.array([model["w"][features(t, mark)].sum(dtype=np.float64) for t in texts]) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, score_as: str = "score") -> DataFrame:
    """The rows of ``docs`` with the toxicity of the whole text, from 0 to 1.

    Null and empty texts have no feature and get the bias's score. A column named like the output is replaced;
    equal texts get equal scores; no rows, no scores.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: list) -> dict:
        return {score_as: predict(told.value, texts)}

    return map_text(docs, text_col, fn, [T.StructField(score_as, T.DoubleType())], keep)
