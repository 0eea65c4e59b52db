"""Incremental gridding of arriving particle files (an extension; the batch operators don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import cell


def stream_field(particles: DataFrame, box: float, n: int) -> DataFrame:
    """Running sums by cell of a streaming particle table, for update or complete output."""
    return particles.groupBy(cell("x", box, n).alias("i"), cell("y", box, n).alias("j")).agg(F.sum("mass").alias("value"))


def start(spark: SparkSession, path: str, schema, box: float, n: int, name: str, checkpoint: str):
    """Follow a folder of Parquet files into an in-memory table of the current field."""
    field = stream_field(spark.readStream.schema(schema).parquet(path), box, n)
    return field.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


# ---------------------------------------------------------------- a stored field that grows


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose field was written to its end, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    done = [int(x.removeprefix("batch=")) for x in names if x.startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS"))]
    return sorted(done)


def merge(arrived: DataFrame, batch: int, path: str, box: float, n: int) -> None:
    """Add a batch of particles to the field at ``path``, once for each batch number.

    The field after a batch is that before it and the batch's own sums, written beside it: a batch that comes again,
    after a failure or a restart, is added to the same field as the first time. Only the field before the last is dropped.
    """
    spark = arrived.sparkSession
    path = path.rstrip("/")
    known = _versions(spark, path)
    earlier = [b for b in known if b < batch]
    total = stream_field(arrived, box, n)
    if earlier:
        total = total.unionByName(spark.read.parquet(f"{path}/batch={earlier[-1]}")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    total.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    for old in earlier[:-1]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def follow(spark: SparkSession, source: str, schema, path: str, box: float, n: int, checkpoint: str):
    """Follow a folder of Parquet files into a stored field, batch by batch."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(lambda df, batch: merge(df, batch, path, box, n)).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, value): the stored field after the last batch; ValueError before the first."""
    known = _versions(spark, path.rstrip("/"))
    if not known:
        raise ValueError(f"no field at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/batch={known[-1]}").select("i", "j", "value")
