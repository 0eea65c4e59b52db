"""A data source of stored arrays: .npy files, and .npz archives whose members' names are paths.

A partition is a range of rows of one array, found from its header, so that a large file is read by many tasks and none
holds more than a batch of it. Columns that the schema doesn't name aren't made, and of arrays stored by columns not read.
"""

from __future__ import annotations

import fnmatch
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of an array that one task reads, and that it holds at a time.
TASK_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``last`` of an array that lies at ``offset`` of a file, or is packed in its member ``packed``."""

    file: str
    part: int
    path: str
    offset: int
    dtype: str
    shape: tuple
    by_column: bool
    first: int
    last: int
    packed: str = ""


def files_of(pattern: str) -> list[str]:
    """Files of a folder, or those in it whose names match; on any file system that Arrow knows by the path's scheme."""
    folder, _, names = pattern.rpartition("/")
    if not set(names) & set("*?[") and not names.endswith((".npy", ".npz")):
        folder, names = pattern.rstrip("/"), "*.np[yz]"
    system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = [i.path for i in system.get_file_info(fs.FileSelector(at)) if i.is_file and fnmatch.fnmatch(i.path.rpartition("/")[2], names)]
    return sorted(f"{folder}/{p.rpartition('/')[2]}" for p in found)


def _opened(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def _header(f) -> tuple[tuple, bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)


def arrays_of(path: str) -> Iterator[Rows]:
    """The arrays of a file, each as one range of all its rows."""
    part = int(m.group(1)) if (m := re.search(r"part(\d+)", path.rpartition("/")[2])) else 0
    with _opened(path) as f:
        if path.endswith(".npy"):
            shape, by_column, kind = _header(f)
            yield Rows(path, part, "", f.tell(), kind.str, shape, by_column, 0, shape[0] if shape else 1)
            return
        with zipfile.ZipFile(f) as z:
            members = z.infolist()
            for m in members:
                with z.open(m) as inner:
                    shape, by_column, kind = _header(inner)
                    head = inner.tell()
                packed = m.filename if m.compress_type != zipfile.ZIP_STORED else ""
                f.seek(m.header_offset + 26)  # the lengths of the member's name and of what follows it
                name, extra = struct.unpack("<HH", f.read(4))
                yield Rows(path, part, m.filename.removesuffix(".npy"), m.header_offset + 30 + name + extra + head, kind.str, shape, by_column, 0, shape[0] if shape else 1, packed)


def ranges_of(whole: Rows, size: int = TASK_BYTES) -> Iterator[Rows]:
    """An array's rows as tasks; a packed member is one, since it can be read from its beginning only."""
    row = np.dtype(whole.dtype).itemsize * max(1, int(np.prod(whole.shape[1:], dtype=np.int64)))
    step = max(1, size // row) if not whole.packed else max(1, whole.last)
    for at in range(0, max(1, whole.last), step):
        yield Rows(**{**whole.__dict__, "first": at, "last": min(whole.last, at + step)})


def read(rows: Rows, columns: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, values by chosen column) of a range, a batch at a time."""
    kind, wide = np.dtype(rows.dtype), int(np.prod(rows.shape[1:], dtype=np.int64))
    step = max(1, BATCH_BYTES // (kind.itemsize * max(1, wide)))
    with _opened(rows.file) as f:
        if rows.packed:
            with zipfile.ZipFile(f) as z, z.open(rows.packed) as inner:
                _header(inner)
                if rows.by_column:
                    a = np.frombuffer(inner.read(), kind).reshape(wide, rows.shape[0] if rows.shape else 1).T
                    yield 0, a[:, columns]
                    return
                for at in range(0, rows.last, step):
                    n = min(step, rows.last - at)
                    yield at, np.frombuffer(inner.read(n * wide * kind.itemsize), kind).reshape(n, wide)[:, columns]
            return
        for at in range(rows.first, rows.last, step):
            n = min(step, rows.last - at)
            if rows.by_column and wide > 1:
                out = np.empty((n, len(columns)), kind)
                for i, c in enumerate(columns):
                    f.seek(rows.offset + (c * rows.shape[0] + at) * kind.itemsize)
                    out[:, i] = np.frombuffer(f.read(n * kind.itemsize), kind)
                yield at, out
            else:
                f.seek(rows.offset + at * wide * kind.itemsize)
                yield at, np.frombuffer(f.read(n * wide * kind.itemsize), kind).reshape(n, wide)[:, columns]


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.schema, self.pattern = schema, options["path"]
        self.size = int(options.get("taskbytes", TASK_BYTES))
        every = [c for c in options.get("columns", "").split(",") if c]
        self.names = [f.name for f in schema.fields if f.name not in ("part", "path", "idx")]
        self.columns = [every.index(c) if c in every else i for i, c in enumerate(self.names)] if every else list(range(len(self.names)))

    def partitions(self) -> list[Rows]:
        return [r for f in files_of(self.pattern) for a in arrays_of(f) for r in ranges_of(a, self.size)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        wide = int(np.prod(partition.shape[1:], dtype=np.int64))
        if self.columns and max(self.columns) >= wide:
            raise ValueError(f"{partition.file} {partition.path} has {wide} columns")
        for at, a in read(partition, self.columns):
            made = {"part": lambda n=len(a): np.full(n, partition.part, np.int32), "path": lambda n=len(a): [partition.path] * n, "idx": lambda at=at, n=len(a): np.arange(at, at + n)}
            values = {c: np.ascontiguousarray(a[:, i]) for i, c in enumerate(self.names)}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name]() if f.name in made else values[f.name]).cast(f.type) for f in arrow], schema=arrow)


class ArraySource(DataSource):
    """``spark.read.format("arrays").schema("part int, path string, idx long, x double, …")``.

    ``part`` is the number in a file's name, ``path`` an archive member's, ``idx`` the row; each may be left out. The other
    columns are an array's, in order, or by the option ``columns``, which names all that the arrays have. ``taskbytes``
    bounds what a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return "part int, path string, idx long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def arrays(spark: SparkSession, pattern: str, schema: str, columns: tuple[str, ...] = (), task_bytes: int = TASK_BYTES) -> DataFrame:
    spark.dataSource.register(ArraySource)
    return spark.read.format("arrays").schema(schema).option("columns", ",".join(columns)).option("taskbytes", task_bytes).load(pattern)
