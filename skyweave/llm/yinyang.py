"""Centroid clustering of integer vectors with Yinyang bounds.

The first centroids are clustered once into groups. Of each vector one upper bound (to its own centroid) and one lower
bound a group (to the nearest other centroid of the group) are kept. When centroids move, the bounds move with them. A
vector whose upper bound is below all lower ones stays; else its own distance is computed and groups are left out by
their bounds; the centroids of the groups that survive are scanned exactly. Distances are exact integers, so ties are
those of a full scan; bounds are doubles with a margin, and only leave out what is strictly farther.

A round is a pass over the stored vectors, and a sum over those that changed their cluster. The driver holds centroids,
their sums and their groups: k times the number of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard
from .common import stored
from .topk import integer_vectors

#: Centroids for each group, and rounds of their own clustering.
GROUP, GROUP_ROUNDS = 10, 5
#: How much farther a bound must be to leave something out.
_MARGIN = 1e-9
_FAR = np.iinfo(np.int64).max
STATE = T.StructType().add("vec_id", T.LongType()).add("v", T.ArrayType(T.LongType())).add("cluster", T.IntegerType()).add("was", T.IntegerType()).add("upper", T.DoubleType()).add("lower", T.ArrayType(T.DoubleType())).add("distance", T.LongType())


def _highest(v: np.ndarray, c: np.ndarray) -> int:
    """No squared distance is above this."""
    top = max(int(v.max(initial=0)), int(c.max(initial=0))) - min(int(v.min(initial=0)), int(c.min(initial=0)))
    if (out := 4 * top * top * v.shape[1]) >= 2**63:
        raise OverflowError("a squared distance may be beyond 64 bits")
    return out


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, exact; OverflowError where one may pass 64 bits."""
    if _highest(v, c) < 2**53:
        v, c = v.astype(np.float64), c.astype(np.float64)
    out = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    return out.astype(np.int64)


def own_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row to the same row of ``c``."""
    _highest(v, c)
    return ((v - c) ** 2).sum(axis=1)


def groups_of(c: np.ndarray, size: int = GROUP, rounds: int = GROUP_ROUNDS) -> np.ndarray:
    """The group of each centroid, by a few rounds of plain clustering from evenly spaced ones."""
    t = max(1, len(c) // size)
    x = c.astype(np.float64)
    centre = x[np.arange(t) * len(c) // t]
    for _ in range(rounds):
        own = ((x[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centre = np.stack([x[own == g].mean(axis=0) if (own == g).any() else centre[g] for g in range(t)])
    return np.unique(own, return_inverse=True)[1] if len(c) else np.zeros(0, np.int64)


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters, bounds and exact distances, and how many distances to other centroids were computed.

    ``moved`` is how far each centroid went since the bounds held; vectors of cluster -1 have none yet.
    """
    cluster, fresh, scanned = cluster.copy(), cluster < 0, 0
    cluster[fresh] = 0
    members = [np.flatnonzero(group == g) for g in range(lower.shape[1])]
    upper = upper + moved[cluster]
    lower = np.where(fresh[:, None], -np.inf, lower - np.array([moved[m].max(initial=0) for m in members]))
    todo = np.flatnonzero(fresh | ~(lower.min(axis=1, initial=np.inf) * (1 - _MARGIN) > upper * (1 + _MARGIN)))  # globally
    best = own_distances(v, c[cluster])
    upper[todo] = np.sqrt(best[todo].astype(np.float64))
    nearest, least = cluster.copy(), best.copy()
    for g, own in enumerate(members):  # then by group
        rows = todo[~(lower[todo, g] * (1 - _MARGIN) > np.sqrt(least[todo].astype(np.float64)) * (1 + _MARGIN))]
        if not len(rows):
            continue
        d = distances(v[rows], c[own])
        scanned += d.size
        line = np.arange(len(rows))
        mine = group[nearest[rows]] == g
        d[line[mine], np.searchsorted(own, nearest[rows[mine]])] = _FAR
        first = d.argmin(axis=1)
        d1 = d[line, first]
        d[line, first] = _FAR
        d2 = d.min(axis=1)
        better = (d1 < least[rows]) | ((d1 == least[rows]) & (d1 < _FAR) & (own[first] < nearest[rows]))
        lower[rows, g] = _root(np.where(better, d2, d1))
        up = rows[better]
        old = group[nearest[up]]
        lower[up, old] = np.minimum(lower[up, old], _root(least[up]))  # the one that is left counts in its group
        nearest[up], least[up] = own[first[better]], d1[better]
    upper[todo] = np.sqrt(least[todo].astype(np.float64))
    return nearest, upper, lower, least, scanned


def _root(d: np.ndarray) -> np.ndarray:
    return np.where(d == _FAR, np.inf, np.sqrt(d.astype(np.float64)))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _assigned(state: DataFrame, c: np.ndarray, group: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The rows of STATE, their ``was`` being their last cluster."""
    groups, dims = int(group.max()) + 1, c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(STATE)
        for b in batches:
            if not b.num_rows:
                continue
            was = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            lower = b.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, groups)
            upper = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            own, upper, lower, least, _ = assign(_vectors(b.column(1), dims), was, upper, lower, c, group, moved)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, groups), pa.int32()), pa.array(lower.ravel()))
            cols = [b.column(0), b.column(1), pa.array(own), pa.array(was), pa.array(upper), lists, pa.array(least)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for f, x in zip(arrow, cols, strict=True)], schema=arrow)

    return state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, STATE)


def _changes(state: DataFrame, k: int, dims: int) -> list:
    """For each cluster and component, what vectors that came and went add; the count is component ``dims``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            v = np.column_stack((_vectors(b.column(0), dims), np.ones(b.num_rows, np.int64)))
            for column, sign in ((b.column(1), 1), (b.column(2), -1)):
                own = column.to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                order = order[own[order] >= 0]
                if len(order):
                    names, at = np.unique(own[order], return_index=True)
                    total[names] += sign * np.add.reduceat(v[order], at, axis=0)
        cluster, part = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(total[cluster, part])], names=["cluster", "part", "s"])

    moved = state.where(F.col("cluster") != F.col("was")).select("v", "cluster", "was").mapInArrow(run, "cluster int, part int, s long")
    return moved.groupBy("cluster", "part").agg(F.sum("s").alias("s")).collect()  # k * (dims + 1) rows at most


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id, in that order; of equal ids the smaller vector, null ids last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dims`` components.

    Components x count as floor(scale * x). The centroids start as ``first_centroids``; each of ``rounds`` rounds
    assigns every vector to the nearest (ties: the smaller number) and moves each centroid that has vectors to the floor
    of their mean; then vectors are assigned once more. Null vectors, and ones with a null or non-finite component or
    another length, are left out; rows with a null id are clustered too, and repeated rows are vectors each. Fewer
    than k vectors are as many centroids; equal centroids keep their numbers, and the larger stay empty. An empty table
    gives no rows. Components so large that a squared distance could pass 64 bits raise an error.
    """
    vectors = stored(integer_vectors(table, id_col, vector_col, scale, null_ids=True).where(F.size("v") == dims))
    c = first_centroids(vectors, k, seed)
    spark = table.sparkSession
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    group, moved = groups_of(c), np.zeros(len(c))
    bare = [F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.array_repeat(F.lit(0.0), int(group.max()) + 1).alias("lower")]
    state, sums = vectors.select("vec_id", "v", *bare), [[0] * (dims + 1) for _ in c]
    last = vectors
    for turn in range(rounds + 1):
        state = stored(_assigned(state, c, group, moved))
        discard(last)
        last = state
        if turn == rounds:
            break
        for r in _changes(state, len(c), dims):
            sums[r["cluster"]][r["part"]] += r["s"]
        new = np.array([[x // s[dims] for x in s[:dims]] if s[dims] else old.tolist() for s, old in zip(sums, c, strict=True)], np.int64)
        moved = np.sqrt(((new - c).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        c = new
    per = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [(i, per.get(i, 0), sum(per.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in enumerate(c.tolist())]
    about = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
