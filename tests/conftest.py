"""A local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    b = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Asserts that a query and its SQL give the same columns and rows over the smallest tables."""
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(query, sql: str) -> None:
        df = query(spark, DATA)
        cols = sorted(df.columns)
        got = sorted(str([_plain(r[c]) for c in cols]) for r in df.collect())
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted(str([_plain(x[names.index(c)]) for c in cols]) for x in r.fetchall())

    return check
