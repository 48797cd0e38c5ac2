"""Series: ordered values with dense positions, and their sliding statistics.

A series is ``pos LONG, value`` with positions 0 to n - 1. Whole-valued series
(``to_fixed``) keep every sum an exact integer, so all strategies agree bit for
bit. Nothing here sorts a whole series in one task: rows are sorted in ranges of
their key and numbered behind the counted ranges before, sliding statistics come
from blocks with a halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifgrid.functions.expressions import exact_sd
from motifgrid.storage import materialize

#: Rows of a block (sliding statistics), about.
BLOCK_ROWS = 65_536
#: Largest ``m * max|value|`` for which exact products and their differences fit 64 bits.
SIGNED_BOUND, UNSIGNED_BOUND = 2_100_000_000, 3_000_000_000


def ranked(rows: DataFrame, *keys: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``pos``: their place in the order of the keys (of any orderable type; nulls first).

    The planner samples the keys and sorts ranges of them; the sorted rows are
    written once, with their place inside the range, and read behind the counts
    of the ranges before. ``ranges`` sets their number (default: the session's).
    """
    ordered = rows.orderBy(*keys) if ranges is None else rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """``pos`` from ``__at``: range number in the high bits, place inside the range in the low 33."""
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    below = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    first = sizes.select("__part", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__first"))
    inside = F.col("__at") - F.shiftleft(part, 33)
    return placed.withColumn("__part", part).join(F.broadcast(first), "__part").withColumn("pos", F.col("__first") + inside).drop("__part", "__first", "__at")


def with_positions(rows: DataFrame, key: str, value: str | Column, check: bool = True, ranges: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """``pos, value`` in the order of ``key``, which must be unique; a null key counts as a value and comes first.

    A key that may repeat takes ``ties``: columns that order rows with equal keys.
    Rows equal in these too stand in the order of their values, so the result is
    always the same.
    """
    value = F.col(value) if isinstance(value, str) else value
    keyed = rows.select(F.col(key).alias("k"), *[F.col(c).alias(f"t{at}") for at, c in enumerate(ties)], value.alias("value"))
    if ties:
        return ranked(keyed, *keyed.columns, ranges=ranges).select("pos", "value")
    if check and not keyed.groupBy("k").count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} repeats, so it doesn't order the rows; give a key with a tie-breaker")
    return ranked(keyed, "k", ranges=ranges).select("pos", "value")


def to_fixed(series: DataFrame, scale: int = 1) -> DataFrame:
    """``pos, c``: values times ``scale`` as whole numbers."""
    return series.select("pos", F.round(F.col("value") * scale).cast("bigint").alias("c"))


def bounds(series: DataFrame) -> tuple[int, int]:
    """Least and largest value of a whole-valued series (0 without values), read once for each DataFrame."""
    found = getattr(series, "_motifgrid_bounds", None)
    if found is None:
        low, high = series.agg(F.min("c"), F.max("c")).first()
        found = series._motifgrid_bounds = (low or 0, high or 0)
    return found


def fits_exactly(series: DataFrame, m: int) -> bool:
    """Whether all sums of products over windows of ``m`` values fit 64 bits."""
    low, high = bounds(series)
    return m * max(abs(low), abs(high)) < (SIGNED_BOUND if low < 0 else UNSIGNED_BOUND)


def _summand(series: DataFrame, rows: int, squares: bool) -> Column:
    """The value column, as wide as running sums of ``rows`` values, or their squares, need."""
    top = max(map(abs, bounds(series)))
    return F.col("c") if rows * top * (top if squares else 1) < 2**62 else F.col("c").cast("decimal(19,0)")


def haloed(series: DataFrame, m: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows with their block number ``b``; the first ``m - 1`` rows after a block are in it too (``own`` false)."""
    block = max(block, m)
    mine = F.col("pos") - F.col("pos") % block
    before = F.when((F.col("pos") % block < m - 1) & (F.col("pos") >= block), F.array(F.expr(f"pos div {block}"), F.expr(f"pos div {block} - 1"))).otherwise(F.array(F.expr(f"pos div {block}")))
    return series.withColumn("b", F.explode(before)).withColumn("own", F.col("b") * block == mine)


def window_sums(series: DataFrame, m: int, block: int = BLOCK_ROWS, squares: bool = True) -> DataFrame:
    """``pos, s0, q0``: sums of values and (if wanted) squares of each full window without a null.

    Running sums inside a block, and the difference of two of them: O(1) a row
    for any ``m``.
    """
    w = Window.partitionBy("b").orderBy("pos")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    c = F.coalesce(_summand(series, max(block, m) + m, squares), F.lit(0))
    rows = haloed(series, m, block).select(
        "b", "pos", "own", c.alias("c"),
        F.sum(c).over(running).alias("p1"), F.sum(c * c).over(running).alias("p2"),
        F.count("c").over(running).alias("pn"), F.when(F.col("c").isNull(), 0).otherwise(1).alias("one"),
    )
    ends = rows.select("pos", "own", "c", "p1", "p2", "pn", "one", *[F.lead(x, m - 1).over(w).alias(f"e_{x}") for x in ("p1", "p2", "pn")])
    full = ends.filter(F.col("own") & (F.col("e_pn") - F.col("pn") + F.col("one") == m))
    sums = [(F.col("e_p1") - F.col("p1") + F.col("c")).cast("bigint").alias("s0")]
    return full.select("pos", *sums, *[(F.col("e_p2") - F.col("p2") + F.col("c") * F.col("c")).cast("bigint").alias("q0")] * squares)


def window_stats(series: DataFrame, m: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``pos, s0, q0, sd``; ``sd`` is ``m`` times the population standard deviation."""
    return window_sums(series, m, block).withColumn("sd", exact_sd(m, F.col("s0"), F.col("q0")))


def mean_std(series: DataFrame, m: int, scale: int = 1, block: int = BLOCK_ROWS) -> DataFrame:
    """``pos, mean, sd`` in the units of the original values."""
    return window_stats(series, m, block).select("pos", (F.col("s0") / F.lit(float(m * scale))).alias("mean"), (F.col("sd") / F.lit(float(m * scale))).alias("sd"))


def scaled_stats(series: DataFrame, m: int, scale: int = 1, block: int = BLOCK_ROWS) -> DataFrame:
    """``pos, inv_sd, scaled_mean``: one over the deviation, and the mean over it times the root of ``m``; null for constant windows."""
    s = mean_std(series, m, scale, block)
    inv = F.when(F.col("sd") != 0, 1 / F.nullif(F.col("sd"), F.lit(0.0)))
    return s.select("pos", inv.alias("inv_sd"), (F.col("mean") * inv * F.sqrt(F.lit(float(m)))).alias("scaled_mean"))


def prefix_sums(series: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """``pos, cum, cum_sq``: running sums from the first position, by blocks and block totals."""
    blocked = series.withColumn("b", F.expr(f"pos div {block}"))
    total = blocked.groupBy("b").agg(F.sum("c").alias("t1"), F.sum(F.col("c") * F.col("c")).alias("t2"))
    below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    total = total.select("b", F.coalesce(F.sum("t1").over(below), F.lit(0)).alias("o1"), F.coalesce(F.sum("t2").over(below), F.lit(0)).alias("o2"))
    run = Window.partitionBy("b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.select("b", "pos", F.sum("c").over(run).alias("i1"), F.sum(F.col("c") * F.col("c")).over(run).alias("i2"))
    return inside.join(total, "b").select("pos", (F.col("i1") + F.col("o1")).alias("cum"), (F.col("i2") + F.col("o2")).alias("cum_sq"))


def lag_product(series: DataFrame, diag: int) -> DataFrame:
    """``pos, product``: the value times the one ``diag`` before it; an equi-join, so any distance shuffles the same."""
    back = series.select((F.col("pos") + diag).alias("pos"), F.col("c").alias("d"))
    return series.join(back, "pos").select("pos", (F.col("c") * F.col("d")).alias("product"))


def _diagonal(series: DataFrame, diag: int) -> DataFrame:
    """The products of a diagonal as a series of their own."""
    shifted = lag_product(series, diag).select((F.col("pos") - diag).alias("pos"), F.col("product").alias("c"))
    top = max(map(abs, bounds(series))) ** 2
    shifted._motifgrid_bounds = (-top, top)
    return shifted


def diagonal_dots(series: DataFrame, m: int, diag: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``i, dot``: dot products of the windows at i and i + diag, by running sums of the lag products."""
    return window_sums(_diagonal(series, diag), m, block, squares=False).select(F.col("pos").alias("i"), F.col("s0").alias("dot"))


def diagonal_cumulative(series: DataFrame, m: int, diag: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``i, cum, dot``: the running sum of a diagonal's products, and its difference over ``m`` (null for the last ones)."""
    shifted = _diagonal(series, diag)
    cum = prefix_sums(shifted, block).select("pos", "cum")
    return cum.join(window_sums(shifted, m, block, squares=False).select("pos", "s0"), "pos", "left").select(F.col("pos").alias("i"), "cum", F.col("s0").alias("dot"))
