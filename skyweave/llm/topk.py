"""Exact top-k inner-product search by a three-phase uniform threshold.

Equal vectors are one class. The components are split into ``SLICES`` slices, and a task holds one slice of a block of
classes and of a block of queries: for each query a list of partial scores. Phase one gathers the ``k`` best of each
list and scores these few in full; the k-th best of them is a safe cutoff, below which no answer lies. Phase two sends
the cutoff out: a class that reaches it reaches its m-th part in one of m slices at least, so only such entries are
collected. Phase three resolves the scores of the entries, and ranks what reaches the cutoff.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SLICES = 2
#: Rows of a block of classes and of a block of queries: the bound on what one task holds.
CLASS_ROWS = 16384
QUERY_ROWS = 2048
#: Blocks have so many classes at least, where there are cores for more.
LEAST_ROWS = 512
#: Partial scores that one task computes at a time.
_CELLS = 1 << 22


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, null_ids: bool = False) -> DataFrame:
    """(vec_id, v) with each component x as floor(scale * x). Null vectors, ones with a null or non-finite component, and (but for ``null_ids``) null ids are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return table.where((F.lit(null_ids) | F.col(id_col).isNotNull()) & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(c, v, dims, ids, only): each different vector with its k + 1 smallest ids, and its id if it has one only.

    ``ids`` are pairs of an id and its number of rows. More can't be among a query's k answers: one of the ids may be
    the query's own. Rows are summed and ranked where they are read, so a very common vector takes no task more.
    """
    per = vectors.groupBy("v", "vec_id").agg(F.count("*").alias("n"))
    place = Window.partitionBy("v").orderBy("vec_id")
    least = per.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    c = least.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    return stored(c.select(F.monotonically_increasing_id().alias("c"), "v", F.size("v").alias("dims"), "ids", F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"]).alias("only")))


def _sliced(frame: DataFrame, slices: int, *cols: str) -> DataFrame:
    """A row for each slice: its number, how many there are, its components, and the columns ``cols``."""
    m = F.least(F.lit(slices), F.greatest(F.lit(1), F.col("dims")))
    x = frame.select(*cols, "dims", "v", m.alias("m")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    lo, hi = ((F.floor(F.col("dims") * i / F.col("m"))).cast("int") for i in (F.col("s"), F.col("s") + 1))
    return x.select(*cols, "dims", "m", "s", F.slice("v", lo + 1, hi - lo).alias("part"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column])


def _narrow(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The narrowest type in which all sums of products are exact."""
    top = float(np.abs(q).max(initial=1)) * float(np.abs(c).max(initial=1)) * max(1, q.shape[1])
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object
    return q.astype(kind), c.astype(kind)


def _tiles(cs: pd.DataFrame, qs: pd.DataFrame):
    """Runs of queries, and their partial scores with all classes of the block; a query's own class is out."""
    q, c = _narrow(_matrix(qs.qpart), _matrix(cs.part))
    only, own = cs.only.to_numpy(float, na_value=np.nan), qs.query_id.to_numpy()
    step = max(1, _CELLS // len(c))
    for at in range(0, len(q), step):
        score = (q[at : at + step] @ c.T).astype(np.float64)
        score[only[None, :] == own[at : at + step, None]] = -np.inf
        yield at, score


def _best_of_lists(k: int):
    def run(cs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"q": [], "s": [], "c": [], "partial": []}).astype({"q": "int64", "s": "int32", "c": "int64", "partial": "float64"})]
        if len(cs) and len(qs):
            c, q, top = cs.c.to_numpy(), qs.q.to_numpy(), min(k, len(cs))
            for at, score in _tiles(cs, qs):
                near = np.argpartition(-score, top - 1, axis=1)[:, :top]
                partial = np.take_along_axis(score, near, 1)
                rows, cols = np.nonzero(np.isfinite(partial))
                found.append(pd.DataFrame({"q": q[at + rows], "s": np.int32(cs.s.iloc[0]), "c": c[near[rows, cols]], "partial": partial[rows, cols]}))
        return pd.concat(found)

    return run


def _enough(cs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
    """Entries of a list that reach the cutoff's share of a slice: each query's as one row, a bit for each class of the block."""
    found = [pd.DataFrame({"dims": [], "cb": [], "qb": [], "q": [], "bits": []}).astype({"dims": "int32", "cb": "int32", "qb": "int32", "q": "int64", "bits": object})]
    if len(cs) and len(qs):
        block = {x: np.int32(cs[x].iloc[0]) for x in ("dims", "cb", "qb")}
        cs = cs.sort_values("c")
        q, share = qs.q.to_numpy(), qs.cutoff.to_numpy(float, na_value=-np.inf) / cs.m.iloc[0]
        for at, score in _tiles(cs, qs):
            reach = (score >= share[at : at + len(score), None]) & np.isfinite(score)
            some = np.flatnonzero(reach.any(axis=1))
            bits = np.packbits(reach[some], axis=1)
            found.append(pd.DataFrame({**block, "q": q[at + some], "bits": [x.tobytes() for x in bits]}))
    return pd.concat(found)


def _resolve(k: int):
    """Scores of a block's entries that reach their cutoffs and the k best of the block. Of classes and queries the vector is given, of entries none."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        cs, qs, pairs = (block[block.kind == i] for i in range(3))
        if not len(pairs):
            return pd.DataFrame({"q": [], "c": [], "score": []}).astype("int64")
        cs, qs, pairs = cs.sort_values("c"), qs.sort_values("q"), pairs.sort_values("q")
        q, c = _narrow(_matrix(qs.v), _matrix(cs.v))
        cutoff, names = qs.cutoff.to_numpy(float, na_value=-np.inf), cs.c.to_numpy()
        step, found = max(1, _CELLS // max(1, q.shape[1])), []
        for i, bits in pairs.groupby("q").bits:  # a query's entries of several lists are one
            at_q = int(np.searchsorted(qs.q.to_numpy(), i))
            at = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in bits]), count=len(cs)))
            score = np.concatenate([(c[at[j : j + step]] * q[at_q]).sum(axis=1) for j in range(0, len(at), step)])
            if not np.all(np.abs(score.astype(float)) < 2.0**63):
                raise OverflowError("a score is beyond 64 bits")
            least = max(cutoff[at_q], float(np.partition(score.astype(float), -k)[-k]) if len(score) > k else -np.inf)
            keep = score.astype(float) >= least
            found.append(pd.DataFrame({"q": np.full(keep.sum(), i, np.int64), "c": names[at[keep]], "score": score[keep].astype(np.int64)}))
        return pd.concat(found)

    return run


def _entries(found: DataFrame, classes: DataFrame, cb: Column) -> DataFrame:
    """(q, c) of the entries' bits."""
    own = classes.select("dims", cb.alias("cb"), "c").groupBy("dims", "cb").agg(F.sort_array(F.collect_list("c")).alias("cs"))  # CLASS_ROWS or so

    def run(batches):
        for p in batches:
            for q, bits, cs in zip(p.q, p.bits, p.cs, strict=True):
                yield pd.DataFrame({"q": q, "c": np.asarray(cs)[np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(cs)))]})

    return found.join(own, ["dims", "cb"]).select("q", "bits", "cs").mapInPandas(run, "q long, c long").distinct()


def _resolved(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """(q, c, score) of pairs (q, c)."""
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    return pairs.join(queries.select("q", F.col("v").alias("qv")), "q").join(classes.select("c", "v"), "c").select("q", "c", product.alias("score"))


def phases(table: DataFrame, query_ids, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, slices: int = SLICES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the search gathers, collects and answers: cutoffs (q, cutoff), entries (q, c), answers as of ``top_k``."""
    spark = table.sparkSession
    v = integer_vectors(table, id_col, vector_col, scale)
    classes = _classes(v, k)
    asked: Column = query_ids(F.col("vec_id"))
    queries = v.where(asked).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("times"))
    queries = stored(queries.select(F.monotonically_increasing_id().alias("q"), "query_id", "v", F.size("v").alias("dims"), "times"))
    n, nq, parts = classes.count(), queries.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    nc, nb = max(1, -(-n // CLASS_ROWS), min(parts, n // LEAST_ROWS)), max(1, -(-nq // QUERY_ROWS))
    blocked = classes.withColumn("cb", F.pmod(F.xxhash64("c"), F.lit(nc)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    asking = queries.withColumn("of_qb", F.pmod(F.xxhash64("q"), F.lit(nb)).cast("int")).withColumn("of_cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    cs = _sliced(blocked, slices, "c", "only", "cb", "qb")
    qs = _sliced(asking, slices, "q", "query_id", "of_qb", "of_cb").withColumnsRenamed({"part": "qpart", "s": "of_s", "dims": "qdims"}).drop("m")
    keys, of_keys = ["dims", "s", "cb", "qb"], ["qdims", "of_s", "of_cb", "of_qb"]

    lists = cs.groupBy(*keys).cogroup(qs.groupBy(*of_keys)).applyInPandas(_best_of_lists(k), "q long, s int, c long, partial double")
    best = Window.partitionBy("q", "s").orderBy(F.col("partial").desc(), "c")
    gathered = lists.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "c").distinct()
    place = Window.partitionBy("q").orderBy(F.col("score").desc(), "c")
    cutoff = stored(_resolved(gathered, queries, classes).withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select("q", F.col("score").alias("cutoff")))

    cut = cutoff.select(F.col("q").alias("of"), F.col("cutoff").cast("double").alias("cutoff"))
    told = qs.join(cut, F.col("q") == F.col("of"), "left").drop("of")
    entries = stored(cs.groupBy(*keys).cogroup(told.groupBy(*of_keys)).applyInPandas(_enough, "dims int, cb int, qb int, q long, bits binary"))

    of_c = blocked.select(F.lit(0).alias("kind"), "dims", "cb", "qb", F.lit(-1).cast("long").alias("q"), "c", "v", F.lit(None).cast("double").alias("cutoff"), F.lit(None).cast("binary").alias("bits"))
    of_q = asking.join(cut, F.col("q") == F.col("of"), "left").select(F.lit(1).alias("kind"), "dims", F.col("of_cb").alias("cb"), F.col("of_qb").alias("qb"), "q", F.lit(-1).cast("long").alias("c"), "v", "cutoff", F.lit(None).cast("binary").alias("bits"))
    of_pairs = entries.select(F.lit(2).alias("kind"), "dims", "cb", "qb", "q", F.lit(-1).cast("long").alias("c"), F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast("double").alias("cutoff"), "bits")
    scored = of_c.unionByName(of_q).unionByName(of_pairs).groupBy("dims", "cb", "qb").applyInPandas(_resolve(k), "q long, c long, score long")
    rows = scored.join(classes.select("c", "ids"), "c").join(queries.select("q", "query_id", "times"), "q").select("q", "query_id", "times", "score", F.explode("ids").alias("x"))
    rows = rows.where(F.col("x.vec_id") != F.col("query_id")).select("q", "query_id", "times", "score", F.col("x.vec_id").alias("vec_id"), F.explode(F.array_repeat(F.lit(1), F.least(F.col("x.n"), F.lit(k)).cast("int"))).alias("one"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    answers = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return cutoff, _entries(entries, classes, F.pmod(F.xxhash64("c"), F.lit(nc)).cast("int")), answers.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one")).drop("one")


def top_k(table: DataFrame, query_ids, k: int = 5, **kwargs) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest inner products with the other rows.

    ``query_ids`` is a predicate on the id column. Ties go to the smaller id; fewer than k rows are all returned.
    Rows with the query's own id are never candidates; rows that share an id are candidates each, and answer as one
    query for each row. Vectors of different lengths aren't compared; empty ones score 0 with each other. A score
    beyond 64 bits raises an error. An empty table has no answers.
    """
    return phases(table, query_ids, k, **kwargs)[2]
