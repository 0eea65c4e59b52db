"""Intermediate tables, kept in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, one of our own: in the warehouse, which is shared too, or on a local master, whose tasks and
    driver are one machine, a temporary one.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        alone = sc.master == "local" or sc.master.startswith("local[")
        path = tempfile.mkdtemp(prefix="skyweave-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/skyweave-scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder. What is written there is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The table, written as Parquet to the shared folder and read again: it survives lost executors."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more. Other tables are left alone."""
    if path := df.__dict__.get("stored_at"):
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
