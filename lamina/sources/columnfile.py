"""Column files: a 64-byte little-endian header, then the columns one after the other.

Spark data source `columnfile`: options `path` and, to write, `element_bytes` (4 or 8) and `seed`. A file
is read in slices of rows: a slice seeks into every column. Keys of 8 bytes are decimals (0 to 2^64-1),
of 4 bytes longs. A write leaves one file a partition; ids of commits keep lost attempts out.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

# fixed values: magic, version and layout of the header
MAGIC = b"TSLDSET1"
VERSION = 1
HEADER = "<8sIIQIIQ"
HEADER_BYTES = 64
SLICE = 1 << 20


@dataclass
class Header:
    element_bytes: int
    rows: int
    columns: int
    seed: int

    def pack(self) -> bytes:
        return struct.pack(HEADER, MAGIC, VERSION, self.element_bytes, self.rows, self.columns, 0, self.seed).ljust(HEADER_BYTES, b"\0")


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        raw = f.read(HEADER_BYTES)
    if len(raw) < HEADER_BYTES:
        raise ValueError(f"{path}: shorter than its header")
    magic, version, width, rows, columns, _, seed = struct.unpack_from(HEADER, raw)
    if magic != MAGIC or version != VERSION or width not in (4, 8):
        raise ValueError(f"{path}: not a column file of version {VERSION}")
    if os.path.getsize(path) != HEADER_BYTES + rows * columns * width:
        raise ValueError(f"{path}: its length does not fit its header")
    return Header(width, rows, columns, seed)


def write_file(path: str, columns: list[np.ndarray], element_bytes: int = 4, seed: int = 0) -> None:
    kind = np.dtype(f"<u{element_bytes}")
    with open(path, "wb") as f:
        f.write(Header(element_bytes, len(columns[0]) if columns else 0, len(columns), seed).pack())
        for c in columns:
            f.write(np.ascontiguousarray(c, kind).tobytes())


@dataclass
class Slice(InputPartition):
    path: str
    begin: int
    end: int


class ColumnFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "columnfile"

    def _files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        return sorted(glob.glob(f"{path}/*.col")) if os.path.isdir(path) else [path]

    def schema(self) -> StructType:
        head = read_header(self._files()[0])
        kind = LongType() if head.element_bytes == 4 else DecimalType(20, 0)
        return StructType([StructField("pos", LongType(), False)] + [StructField(f"k{i}", kind, False) for i in range(head.columns)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self._files())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options, schema)


class Reader(DataSourceReader):
    def __init__(self, files: list[str]) -> None:
        self.files = files

    def partitions(self) -> list[Slice]:
        return [Slice(p, a, min(n, a + SLICE)) for p in self.files for n in [read_header(p).rows] for a in range(0, n, SLICE)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        head = read_header(partition.path)
        before = sum(read_header(p).rows for p in self.files[: self.files.index(partition.path)])
        kind, n = np.dtype(f"<u{head.element_bytes}"), partition.end - partition.begin
        arrays = [pa.array(np.arange(before + partition.begin, before + partition.end))]
        for i in range(head.columns):
            x = np.fromfile(partition.path, kind, n, offset=HEADER_BYTES + (i * head.rows + partition.begin) * head.element_bytes)
            arrays.append(pa.array(x.astype(np.int64)) if head.element_bytes == 4 else pa.array([Decimal(int(v)) for v in x], pa.decimal128(20, 0)))
        yield pa.RecordBatch.from_arrays(arrays, names=["pos", *(f"k{i}" for i in range(head.columns))])


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder = options["path"].removeprefix("file://")
        self.width, self.seed = int(options.get("element_bytes", 4)), int(options.get("seed", 0))
        self.names = [f.name for f in schema if f.name != "pos"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        rows = pa.Table.from_batches(list(iterator))
        if "pos" in rows.column_names:
            rows = rows.sort_by("pos")
        path = f"{self.folder}/{uuid.uuid4().hex}.tmp"
        first = rows.column("pos")[0].as_py() if "pos" in rows.column_names and rows.num_rows else 0
        write_file(path, [np.array([int(v) for v in rows.column(c).to_pylist()], np.uint64) for c in self.names] if rows.num_rows else [np.empty(0)] * len(self.names), self.width, self.seed)
        return Written(f"{path}|{first:020d}")

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                path, first = m.path.split("|")
                os.replace(path, f"{self.folder}/{first}-{os.path.basename(path)[:8]}.col")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(path := m.path.split("|")[0]):
                os.remove(path)


def register(spark) -> None:  # noqa: ANN001
    spark.dataSource.register(ColumnFile)
