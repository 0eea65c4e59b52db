"""Token-ID output: documents to ids, ids to files of range-coded blocks, and back.

Documents are range-partitioned by id and sorted, so that files follow the order of ids. A partition writes segments
of whole documents, one row of a Parquet file each (Spark commits the files of finished tasks only); a segment holds
blocks that are coded and checksummed on their own (see ``range_coder``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch
from .common import slices
from .pieces import Pieces
from .range_coder import BLOCK, pack, unpack

#: Ids after which a segment ends, with the document then at hand.
SEGMENT_IDS = BLOCK
#: The id behind each document.
END = 0
SEGMENT = "part int, segment int, n_docs long, n_ids long, data binary"
_WORKER: dict[str, Pieces] = {}


def _tokenizer(path: str) -> Pieces:
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes side by side, and where each begins and the last ends; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)), edges - edges[0]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts of an Arrow array, and how many each has."""
    return _tokenizer(path).ids_of(*_bytes(texts))


def segments(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SEGMENT, in ascending document order within and across partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            data = pack(docs, np.concatenate(counts), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "segment", "n_docs", "n_ids", "data"])

        for b in slices(batches, 1):
            found, n = token_ids(b.column(1), tokenizer_path)
            ends = np.cumsum(n)
            found, n, names = np.insert(found, ends, END), n + 1, b.column(0).to_pylist()
            ends = np.cumsum(n)
            at = 0
            while at < len(n):  # documents up to the segment's end
                before = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(ends, before + SEGMENT_IDS - size)) + 1, len(n))
                docs += names[at:to]
                counts.append(n[at:to])
                ids.append(found[before : ends[to - 1]])
                size += int(ends[to - 1]) - before
                at = to
                if size >= SEGMENT_IDS:
                    yield row()
                    number, docs, counts, ids, size = number + 1, [], [], [], 0
        if docs:
            yield row()

    # rows of one id lie by their texts' hashes, and equal ones by where they came from: no id is all in one task
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("r"))
    order = [F.col("d").asc_nulls_first(), "h", "r"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("d", "t").mapInArrow(run, SEGMENT)


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **kwargs) -> str:
    """Write the files and return their folder: the one given, or one in the shared folder until the application ends."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    segments(docs, tokenizer_path, **kwargs).write.parquet(folder)
    return folder


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and with ``with_ids`` its ids.

    ``start`` counts the ids of all documents before it; documents come in ascending id, null first, and equal ids by
    a hash of their texts. ``n_tokens`` and the checksum include the end id. A null or empty text is its end id alone. A
    block whose checksum is wrong raises ValueError. A folder without documents gives no rows.
    """
    found = read_segments(spark, folder)
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([T.StructField(n, k) for n, k in (("part", T.IntegerType()), ("segment", T.IntegerType()), ("doc_id", T.LongType()), ("at", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs, counts, ids = unpack(data)
                edges = np.concatenate(([0], np.cumsum(counts)))
                raw = ids.astype("<u4")
                cols = [pa.array([part] * len(docs), pa.int32()), pa.array([segment] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(edges[:-1]), pa.array(counts), pa.array([zlib.crc32(raw[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(raw.view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    docs = found.select("part", "segment", "data").mapInArrow(run, schema)
    # offsets from the segments' sizes: sums of partitions, then within a partition
    sizes = found.select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("part").alias("p"), F.col("segment").alias("s"), F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("own")).join(parts, "p").select("p", "s", (F.col("own") + F.col("base")).alias("offset"))
    rows = docs.join(offsets, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s")))
    return rows.select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
