"""Shared helpers of the training-data operators.

``materialize`` is the only way these operators cut lineage: it writes a
Parquet table to the folder that ``spark.checkpoint.dir`` names and reads it
back, so a lost executor costs the re-run of one stage, never of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from motifgrid.storage import discard, materialize, passing, ship_package

__all__ = ["bound", "discard", "id_remainder", "map_rows", "materialize", "passing", "read_table", "ship_package", "slices", "whole"]

#: Rows that a Python function gets at once; Spark bounds the bytes of the batches that they are cut from.
BATCH_ROWS = 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches of a Python stage in few rows at a time, whatever the session's batch size is."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: T.StructType | str, rows: int = BATCH_ROWS) -> DataFrame:
    """Apply a function of whole columns to ``df``, ``rows`` rows at a time.

    ``make`` is called once in each task and returns the function; it gets one
    Python list for each input column and returns one for each output column.
    """
    ship_package(df.sparkSession)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in slices(batches, rows):
            out = fn([batch.column(k).to_pylist() for k in range(batch.num_columns)])
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` reads it.

    The optimizer puts an expression in wherever its alias is read, also inside
    conditions and lambdas; a lambda's variable is computed once.
    """
    return F.transform(F.array(value), use)[0]


def whole(text: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def id_remainder(doc_id: str, of: int = 4) -> Column:
    """crc32 of the id's decimal text modulo ``of``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of))
