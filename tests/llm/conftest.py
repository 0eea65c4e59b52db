"""Small document tables with the cases that every operator must take."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

#: Columns that no operator may trip over.
CLASHES = ["score", "t", "k", "n", "pos", "component_id", "size", "copies", "part", "held_out", "__text", "__id", "keep"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])


def words(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x" for _ in range(n)]


LONG = " ".join(words(60_000, 1, 5000))
COPY = " ".join(words(80, 2)) + "\nA line of at least twenty letters\nshort"


def odd_rows() -> list[tuple]:
    rest = ("en", "web", *["clash"] * len(CLASHES))
    none = (None,) * (2 + len(CLASHES))
    return [(None, COPY, *rest), (1, None, *rest), (2, "", *rest), (3, LONG, *rest), (4, COPY, *rest), (4, COPY, *rest), (5, COPY, *none), (6, COPY, *rest), (7, " \t\n", *rest), (8, "one", "fr", None, *rest[2:]), (9, "\n\n", *none), (None, None, *none)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
