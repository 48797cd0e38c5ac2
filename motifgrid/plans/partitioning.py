"""Work partitioning formulas as small relations: even splits, balanced pairs, the triangle grid."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_work(spark: SparkSession, parts: int, items: int) -> DataFrame:
    """``part, first, last, size``: ``items`` in ``parts`` runs whose sizes differ by one at most, the longer ones first."""
    if parts < 1 or items < 0:
        raise ValueError("parts must be positive and items not negative")
    big, small = items % parts, items // parts
    rows = spark.range(parts).select(F.col("id").alias("part"))
    rows = rows.withColumn("size", F.lit(small).cast("bigint") + (F.col("part") < big).cast("bigint"))
    rows = rows.withColumn("first", F.col("part") * small + F.least(F.col("part"), F.lit(big)))
    return rows.select("part", "first", (F.col("first") + F.col("size") - 1).alias("last"), "size")


def balanced_pairs(spark: SparkSession, ranks: int, diagonals: int) -> DataFrame:
    """``rank, part, first, last, size``: each rank gets a run of long and one of short diagonals."""
    runs = split_work(spark, 2 * ranks, diagonals)
    rank = F.when(F.col("part") < ranks, F.col("part")).otherwise(2 * ranks - 1 - F.col("part"))
    return runs.select(rank.alias("rank"), "part", "first", "last", "size")


def diagonal_blocks(spark: SparkSession, diagonals: int, length: int) -> DataFrame:
    """``block, first, last``: runs of ``length`` diagonals, the last one shorter."""
    rows = spark.range(-(-diagonals // length)).select(F.col("id").alias("block"), (F.col("id") * length).alias("first"))
    return rows.withColumn("last", F.least(F.col("first") + length - 1, F.lit(diagonals - 1).cast("bigint")))


def triangle_tiles(spark: SparkSession, side: int) -> DataFrame:
    """``rank, row, col, is_upper``: the triangles of a lower-triangular grid of ``side`` rows, in rank order.

    Row r holds 2r + 1 triangles; each square below the diagonal is an upper
    and a lower one, a diagonal square is a single one.
    """
    rows = spark.range(side * side).select(F.col("id").alias("rank"), F.floor(F.sqrt("id")).cast("bigint").alias("row"))
    rows = rows.withColumn("col", F.expr("(rank - row * row) div 2"))
    odd = F.col("rank") % 2 == 1
    return rows.withColumn("is_upper", F.when(F.col("row") % 2 == 0, odd).otherwise(~odd))


def tile_ranks(spark: SparkSession, side: int) -> DataFrame:
    """``line, kind, ranks, n, reader``: the ranks of each grid row and column, and the diagonal rank that reads for it."""
    t = triangle_tiles(spark, side)
    reads = F.max(F.when(F.col("row") == F.col("col"), F.col("rank"))).alias("reader")
    row = t.groupBy(F.col("row").alias("line")).agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"), reads).withColumn("kind", F.lit("row"))
    col = t.groupBy(F.col("col").alias("line")).agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"), reads).withColumn("kind", F.lit("column"))
    return row.unionByName(col).select("kind", "line", "n", "first_rank", "reader")


def tile_geometry(spark: SparkSession, lengths: DataFrame, m: int, side: int) -> DataFrame:
    """``n, work, pad, tile_length`` of a padded grid for each series length ``n``; the engine itself cuts ragged tiles."""
    work = F.col("n") - m - m // 4
    pad = F.when(work % side == 0, 0).otherwise(side - work % side)
    rows = lengths.select("n", work.alias("work"), pad.cast("bigint").alias("pad"))
    return rows.withColumn("tile_length", F.expr(f"(n + pad - {m + m // 4}) div {side}"))


#: Fixed value: square counts below this may lie under the power that they stand for.
SMALL_SQUARE = 20


def next_process_count(current: int, mode: str, base: int = 2) -> int:
    """The next count of a scaling run.

    ``linear`` adds the base, ``square`` takes the next square number, ``exp`` the
    next power of the base, and ``square_exp`` a square near that power: the last
    one up to it if that is small and an advance, else the one after.
    """
    if mode not in ("linear", "square", "exp", "square_exp"):
        raise ValueError(f"no scaling mode {mode!r}")
    if current < 1 or base < (1 if mode in ("linear", "square") else 2):
        raise ValueError(f"no {mode} scaling from {current} with base {base}")
    if mode == "linear":
        return current + base
    if mode == "square":
        return (isqrt(current) + 1) ** 2
    power = base
    while power <= current:
        power *= base
    if mode == "exp":
        return power
    root = isqrt(power)
    return root**2 if current < root**2 < SMALL_SQUARE else (root + 1) ** 2
