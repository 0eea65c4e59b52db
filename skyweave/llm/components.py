"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Tasks that a group's rows are spread over.
PIECES = 16


def with_least(rows: DataFrame, keys: list[str], spread: str, value: Column) -> DataFrame:
    """Each row with its group's ``least`` value and row ``count``.

    A group lies in PIECES tasks by the column ``spread``: the least of each piece is found where it lies, and that of
    all goes back to the pieces that there are, so that no task gets the whole of a large group.
    """
    x = rows.withColumn("piece", F.pmod(F.xxhash64(spread), F.lit(PIECES)))
    per = x.groupBy(*keys, "piece").agg(F.min(value).alias("least"), F.count("*").alias("count"))
    low = per.groupBy(*keys).agg(F.min("least").alias("least"), F.sum("count").alias("count"), F.collect_list("piece").alias("piece"))
    return x.join(low.withColumn("piece", F.explode("piece")), [*keys, "piece"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return with_least(both, ["a"], "b", F.col("b")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = with_least(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a"], "b", F.col("b"))
    ends = F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))
    return down.select(F.explode(ends).alias("x")).select("x.*").where(F.col("a") != F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge table (a, b) of longs; a component is its smallest node.

    Self links and repeated links change nothing. Every step finds a node's least link where the links lie, in
    several tasks for a hub, and each round is checkpointed. Ends when a round changes no edge.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).head()
        if tuple(now) == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = tuple(now)
        e = cut(_small_star(_large_star(e).distinct()).distinct())
