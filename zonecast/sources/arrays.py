"""A Spark data source for .npy files: rows of an array's indices and values, read by offset in tasks.

The driver reads the header only: order, shape and type make the schema and the partitions, which are runs of elements.
Each task seeks to its run, so an array of any size passes through no single process. Files are opened by pyarrow's
file systems: local paths, and those its URIs name.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and elements of a batch.
PARTITION, BATCH = 16 << 20, 1 << 16
_TYPES = {"f": (T.FloatType(), T.DoubleType()), "i": (T.IntegerType(), T.LongType()), "u": (T.IntegerType(), T.LongType())}


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    fortran: bool
    dtype: str
    offset: int

    @property
    def size(self) -> int:
        return math.prod(self.shape)


def header(path: str) -> Header:
    """Shape, order and type of the file; an error if it is none, holds objects or records, or is cut short."""
    system, inner = _opened(path)
    with system.open_input_file(inner) as file:
        length, start = file.size(), file.read(12)
        if start[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no .npy file")
        more = int.from_bytes(start[8:10] if start[6] == 1 else start[8:12], "little")
        offset = more + (10 if start[6] == 1 else 12)
        read = io.BytesIO(start + file.read(max(0, offset - 12)))
    np.lib.format.read_magic(read)
    parse = np.lib.format.read_array_header_1_0 if start[6] == 1 else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = parse(read)
    if dtype.kind not in "fiub":
        raise ValueError(f"{path} holds {dtype}, not numbers")
    found = Header(shape, bool(fortran), dtype.str, offset)
    if length < offset + found.size * dtype.itemsize:
        raise ValueError(f"{path} is cut short: {length} bytes for shape {shape} of {dtype}")
    return found


def _kind(dtype: np.dtype) -> T.DataType:
    if dtype.kind == "b":
        return T.BooleanType()
    narrow, wide = _TYPES[dtype.kind]
    return narrow if dtype.itemsize < (8 if dtype.kind == "f" else 4 + (dtype.kind == "i")) else wide


@dataclass
class Run(InputPartition):
    """Elements [low, high) in the file's order."""

    low: int
    high: int


class ArrayReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, found: Header, rows: int, size: int):
        self.schema, self.path, self.found, self.size = schema, path, found, size
        # the first rows are the first elements where the first index runs slowest
        self.end = found.size
        self.rows = None
        if rows > 0 and found.shape and rows < found.shape[0]:
            if found.fortran and len(found.shape) > 1:
                self.rows = rows
            else:
                self.end = rows * math.prod(found.shape[1:])

    def partitions(self) -> list[Run]:
        each = max(1, self.size // np.dtype(self.found.dtype).itemsize)
        return [Run(low, min(low + each, self.end)) for low in range(0, self.end, each)] or [Run(0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        dtype, order, fields = np.dtype(self.found.dtype), "F" if self.found.fortran else "C", self.schema.fieldNames()
        system, inner = _opened(self.path)
        with system.open_input_file(inner) as file:
            file.seek(self.found.offset + partition.low * dtype.itemsize)
            for low in range(partition.low, partition.high, BATCH):
                high = min(low + BATCH, partition.high)
                values = np.frombuffer(file.read((high - low) * dtype.itemsize), dtype).astype(dtype.newbyteorder("="))
                index = np.unravel_index(np.arange(low, high), self.found.shape, order) if self.found.shape else ()
                if self.rows is not None:
                    kept = index[0] < self.rows
                    values, index = values[kept], tuple(x[kept] for x in index)
                kind = {"f": pa.float32(), "d": pa.float64(), "?": pa.bool_()}.get(values.dtype.char, pa.float32() if dtype.kind == "f" else pa.int32() if isinstance(self.schema.fields[-1].dataType, T.IntegerType) else pa.int64())
                if dtype.kind == "f" and dtype.itemsize < 4:
                    values = values.astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in index), pa.array(values).cast(kind)], fields)


class ArraySource(DataSource):
    """Format npy. Options: path; names, the index columns' names by commas (i0, i1, ... unless given); value, the value column's;
    rows, to read the first rows only; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _found(self) -> Header:
        return header(self.options["path"])

    def schema(self) -> T.StructType:
        found = self._found()
        names = self.options["names"].split(",") if self.options.get("names") else [f"i{i}" for i in range(len(found.shape))]
        if len(names) != len(found.shape):
            raise ValueError(f"{len(names)} names for shape {found.shape}")
        return T.StructType([*(T.StructField(n.strip(), T.LongType()) for n in names), T.StructField(self.options.get("value", "value"), _kind(np.dtype(found.dtype)))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrayReader(schema, self.options["path"], self._found(), int(self.options.get("rows", 0)), int(self.options.get("partitionbytes", self.options.get("partitionBytes", PARTITION))))


def read_array(spark: SparkSession, path: str, names: tuple[str, ...] = (), value: str = "value", rows: int = 0, partition: int = PARTITION) -> DataFrame:
    """(an index column a dimension, value) of a .npy file."""
    spark.dataSource.register(ArraySource)
    options = {"path": path, "value": value, "rows": rows, "partitionBytes": partition} | ({"names": ",".join(names)} if names else {})
    return spark.read.format("npy").options(**options).load()
