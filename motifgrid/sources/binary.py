"""Binary series and profile files as a Spark data source.

A file has a header area of 100 bytes (format version, data offset as unsigned
32-bit, count as unsigned 64-bit, little-endian) and then 8-byte doubles
(series, version 2) or pairs of squared distance and neighbour (profile,
version 1). Readers take byte ranges in parallel; writers put every row at the
place its position says, so partitions write at once and a repeated task writes
the same bytes again.

    spark.dataSource.register(BinaryFile)
    spark.read.format("motifgrid").option("kind", "series").load(path)

Options: ``kind`` (series or profile), ``partitions``, ``offset`` and
``length`` (a slice by position), ``chunk_rows`` (rows read or written at once).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from motifgrid.storage import plain_path, ship_package

# Fixed values of the format.
HEADER, AREA = struct.Struct("<IIQ"), 100
VERSION = {"series": 2, "profile": 1}
SCHEMA = {"series": "pos bigint, value double", "profile": "pos bigint, dist2 double, nn bigint"}
RECORD = {"series": np.dtype([("value", "<f8")]), "profile": np.dtype([("dist2", "<f8"), ("nn", "<i8")])}
CHUNK_ROWS = 1 << 16


def read_header(path: str, kind: str) -> int:
    """The count of a file, whose version, offset and size are checked."""
    with open(plain_path(path), "rb") as f:
        raw = f.read(HEADER.size)
        size = os.fstat(f.fileno()).st_size
    if len(raw) < HEADER.size:
        raise ValueError(f"{path}: no header")
    version, offset, n = HEADER.unpack(raw)
    if version != VERSION[kind] or offset != AREA:
        raise ValueError(f"{path}: version {version} with data at {offset}; a {kind} file has version {VERSION[kind]} and data at {AREA}")
    if size < AREA + n * RECORD[kind].itemsize:
        raise ValueError(f"{path}: {size} bytes are too few for {n} values")
    return n


@dataclass
class Slice(InputPartition):
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = plain_path(options["path"]), options.get("kind", "series")
        self.offset, self.length = int(options.get("offset", 0)), options.get("length")
        self.parts, self.chunk = int(options.get("partitions", 0)), max(1, int(options.get("chunk_rows", 0)) or CHUNK_ROWS)

    def partitions(self):
        n = read_header(self.path, self.kind)
        count = n - self.offset if self.length is None else int(self.length)
        if self.offset < 0 or count < 0 or self.offset + count > n:
            raise ValueError(f"{self.path}: positions {self.offset} to {self.offset + count - 1} reach outside 0 to {n - 1}")
        parts = max(1, self.parts or min(64, -(-count // (8 * CHUNK_ROWS))))
        cuts = [self.offset + count * k // parts for k in range(parts + 1)]
        return [Slice(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        kind = RECORD[self.kind]
        with open(self.path, "rb") as f:
            f.seek(AREA + partition.first * kind.itemsize)
            for at in range(partition.first, partition.first + partition.count, self.chunk):
                rows = np.fromfile(f, kind, min(self.chunk, partition.first + partition.count - at))
                columns = {"pos": np.arange(at, at + len(rows))} | {k: np.ascontiguousarray(rows[k]) for k in kind.names}
                out = {k: pa.array(v) for k, v in columns.items()}
                if self.kind == "profile":  # no neighbour is -1 in the file, and null here
                    none = rows["nn"] < 0
                    out |= {"nn": pa.array(columns["nn"], mask=none), "dist2": pa.array(columns["dist2"], mask=none)}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


@dataclass
class Written(WriterCommitMessage):
    rows: int
    last: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.kind = plain_path(options["path"]), options.get("kind", "series")
        self.chunk = max(1, int(options.get("chunk_rows", 0)) or CHUNK_ROWS)
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.part = f"{self.path}.part"
        os.makedirs(os.path.dirname(self.part) or ".", exist_ok=True)
        open(self.part, "wb").close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        kind, rows, last = RECORD[self.kind], 0, -1
        fd = os.open(self.part, os.O_WRONLY)
        try:
            for batch in (whole.slice(at, self.chunk) for whole in iterator for at in range(0, whole.num_rows, self.chunk)):
                pos = batch.column(0).to_numpy(zero_copy_only=False)
                if not len(pos):
                    continue
                put = np.empty(len(pos), kind)
                value = batch.column(1).to_numpy(zero_copy_only=False)
                if self.kind == "series":
                    put["value"] = value
                else:
                    put["dist2"] = np.where(batch.column(1).is_null().to_numpy(zero_copy_only=False), np.inf, value)
                    put["nn"] = batch.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.argsort(pos, kind="stable")
                pos, put = pos[order], put[order]
                for run in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) != 1) + 1):
                    os.pwrite(fd, put[run].tobytes(), AREA + int(pos[run[0]]) * kind.itemsize)
                rows, last = rows + len(pos), max(last, int(pos[-1]))
        finally:
            os.close(fd)
        return Written(rows, last)

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        rows, last = sum(m.rows for m in done), max([m.last for m in done], default=-1)
        if rows != last + 1:
            os.remove(self.part)
            raise ValueError(f"{rows} rows for positions up to {last}: positions must be 0 to n - 1, each once")
        with open(self.part, "r+b") as f:
            f.write(HEADER.pack(VERSION[self.kind], AREA, rows).ljust(AREA, b"\0"))
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class BinaryFile(DataSource):
    """Format ``motifgrid``."""

    @classmethod
    def name(cls) -> str:
        return "motifgrid"

    def schema(self) -> str:
        return SCHEMA[self.options.get("kind", "series")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def read_binary(spark: SparkSession, path: str, kind: str = "series", **options) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(BinaryFile)
    reader = spark.read.format("motifgrid").option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def write_binary(df: DataFrame, path: str, kind: str = "series", mode: str = "append", chunk_rows: int = 0) -> None:
    """Write ``pos, value`` (series) or ``pos, dist2, nn`` (profile); ``mode`` append needs a new path, overwrite replaces."""
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(BinaryFile)
    columns = {"series": ("pos", "value"), "profile": ("pos", "dist2", "nn")}[kind]
    rows = df.select(*[F.col(c).cast("bigint" if c in ("pos", "nn") else "double").alias(c) for c in columns])
    rows.write.format("motifgrid").option("kind", kind).option("chunk_rows", chunk_rows).mode(mode).save(path)
