"""Ways to run the all-pairs query; all give the same profile.

``sql``        joins and windows only; quadratic rows through the engine, for short series
``broadcast``  the series goes to every executor once; tiles of the pair triangle are tasks
``shuffle``    blocks of the series are joined to tiles by block number; nothing is replicated whole
``auto``       broadcast while the counted length is under ``BROADCAST_VALUES``, else shuffle

The pair triangle is cut into squares of tiles, one task each; a task folds all
its tiles to one best partner a position before anything is shuffled. With G
squares a side (about the root of eight times the cores, more where a square's
side would pass ``SIDE_VALUES``), the partial results are G rows a position, and
the shuffle strategy sends every value to G tasks. Tiles inside the exclusion
band are left out.

A series of exact whole values that repeats itself is cut down first: positions whose best partner is a
copy of their own window are settled in one pass (``copies``), and only tiles that
another position needs are evaluated.

Values are centred before anything else, on a whole number if they are whole:
distances don't see it. Whole values whose sums then stay exact give equal
results on every strategy (``exact``); all others are general doubles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motifgrid.functions.expressions import exact_correlation
from motifgrid.operators.profiles import best, both_sides, finished
from motifgrid.operators.series import bounds, haloed, window_stats
from motifgrid.sources.generate import draw
from motifgrid.storage import ship_package

from . import copies
from .kernel import Best, cells, exact_bound, on_diagonal, tile

#: Longest series (8 bytes a value) that is sent whole to every executor.
BROADCAST_VALUES = 10_000_000
TILE = 4096
#: Most windows of a square's side, and most partitions that squares are dealt to.
SIDE_VALUES, MOST_PARTITIONS = 1 << 20, 10_000
#: Windows from which copies are looked for first: below, all pairs cost less than that.
COPIES_FROM = 1 << 18
_PARTIAL = "pos bigint, r double, nn bigint"
_ARROW = pa.schema([("pos", pa.int64()), ("r", pa.float64()), ("nn", pa.int64())])


def default_band(m: int) -> int:
    return m // 4


def value_column(series: DataFrame) -> str:
    return "c" if "c" in series.columns else "value"


def checked_length(series: DataFrame, m: int) -> int:
    """Number of positions, counted once for each DataFrame."""
    n = getattr(series, "_motifgrid_length", None)
    if n is None:
        last = series.agg(F.max("pos")).first()[0]
        n = series._motifgrid_length = 0 if last is None else last + 1
    if m < 2:
        raise ValueError("a window has 2 values at least")
    if n < m:
        raise ValueError(f"the series has {n} values, fewer than a window's {m}")
    return n


def centre(series: DataFrame) -> tuple[int | float, int | None]:
    """A number near the values' middle, whole for whole values, and these' largest distance from it (null for doubles)."""
    found = getattr(series, "_motifgrid_centre", None)
    if found is None:
        if value_column(series) == "c":
            low, high = bounds(series)
            middle = (low + high) // 2
            found = middle, high - middle
        else:
            found = series.agg(F.avg(finite("value"))).first()[0] or 0.0, None
        series._motifgrid_centre = found
    return found


def finite(name: str) -> Column:
    """The column as a double, null where it is no finite number."""
    v = F.col(name).cast("double")
    return F.when(F.abs(v) < float("inf"), v)  # NaN counts as larger than any number


def centred(series: DataFrame, m: int) -> tuple[DataFrame, bool]:
    """``pos, v``: the centred values as doubles, null where missing, and whether windows of ``m`` of them are exact."""
    middle, top = centre(series)
    if top is None:
        return series.select("pos", (finite("value") - F.lit(middle)).alias("v")), False
    near = (F.col("c") - F.lit(middle)).cast("double") if top < 2**62 else F.col("c").cast("double") - F.lit(float(middle))
    return series.select("pos", near.alias("v")), exact_bound(m, top)


def collect_values(series: DataFrame, n: int, m: int) -> tuple[np.ndarray, bool]:
    """The centred series as an array, through Arrow (missing positions and nulls are NaN), and whether it is exact."""
    ship_package(series.sparkSession)
    if n > BROADCAST_VALUES:
        raise ValueError(f"{n} values are too many to broadcast; use the shuffle strategy")
    values, exact = centred(series, m)
    table = values.toArrow()
    out = np.full(n, np.nan)
    out[table.column("pos").to_numpy()] = table.column("v").to_numpy()
    return out, exact


def _out(bests: Iterable[Best]) -> Iterator[pa.RecordBatch]:
    for b in bests:
        pos, r, nn = b.rows()
        for at in range(0, len(pos), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (pos, r, nn)], schema=_ARROW)


# --- sql ----------------------------------------------------------------------------------


def cells_sql(series: DataFrame, m: int, band: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """``i, j, r`` of all pairs on the diagonals ``first`` to ``last`` (default: outside the band to the end).

    One equi-join on position for each lag. Whole values take running sums along
    each diagonal and the difference of two of them for the dot product; general
    doubles a sum over each window and deviations in two passes, so nothing
    accumulates.
    """
    n = checked_length(series, m)
    p = n - m + 1
    first, last = band + 1 if first is None else first, p - 1 if last is None else last
    middle, top = centre(series)
    whole = top is not None and max(n, m * m) * top * top < 2**62
    values = series.select("pos", (F.col("c") - F.lit(middle)).alias("c")) if whole else centred(series, m)[0].withColumnRenamed("v", "c")
    lags = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("diag") if first <= last else F.explode(F.array().cast("array<int>")).alias("diag")
    ahead = values.select(F.col("pos").alias("i"), F.col("c").alias("a"), lags).withColumn("pos", F.col("i") + F.col("diag"))
    paired = ahead.join(values.withColumnRenamed("c", "b"), "pos").select("diag", "i", (F.col("a") * F.col("b")).alias("ab"))
    w = Window.partitionBy("diag").orderBy("i")
    if whole:
        run = paired.withColumn("run", F.sum(F.coalesce("ab", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        dots = run.withColumn("end", F.lead("run", m - 1).over(w)).filter("end IS NOT NULL")
        dots = dots.select("i", (F.col("i") + F.col("diag")).alias("j"), (F.col("end") - F.col("run") + F.coalesce("ab", F.lit(0))).alias("q"))
        values._motifgrid_bounds = (-top, top)
        st = window_stats(values, m)
    else:
        frame = w.rowsBetween(0, m - 1)
        dots = paired.select("i", (F.col("i") + F.col("diag")).alias("j"), F.sum("ab").over(frame).alias("q"), F.count("ab").over(frame).alias("n")).filter(F.col("n") == m).drop("n")
        st = two_pass_stats(values, m)
    si, sj = (st.select(F.col("pos").alias(k), F.col("s0").alias(f"s_{k}"), F.col("sd").alias(f"sd_{k}")) for k in ("i", "j"))
    both = dots.join(si, "i").join(sj, "j")
    return both.select("i", "j", exact_correlation(m, F.col("q"), F.col("s_i"), F.col("sd_i"), F.col("s_j"), F.col("sd_j")).alias("r"))


def two_pass_stats(values: DataFrame, m: int) -> DataFrame:
    """``pos, s0, sd`` of each full window of doubles ``c`` without a null: the mean first, then the deviations from it."""
    w = Window.partitionBy("b").orderBy("pos").rowsBetween(0, m - 1)
    held = haloed(values, m).select("pos", "own", F.collect_list("c").over(w).alias("x")).filter(F.col("own") & (F.size("x") == m))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    held = held.withColumn("s0", total)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("s0") / m) * (v - F.col("s0") / m))
    return held.select("pos", "s0", F.when(F.array_max("x") == F.array_min("x"), 0.0).otherwise(F.sqrt(m * square)).alias("sd"))


def diagonal_cells(series: DataFrame, m: int, first: int, last: int, size: int = 1 << 14) -> DataFrame:
    """``i, j, r`` of all pairs on a few diagonals of a series of any length: ``cells_sql`` for lags ``first`` to ``last``.

    Blocks take the ``last`` windows after them along, so every cell is made where
    its block is: the values are shuffled once, whatever the number of diagonals,
    and no row of a cell is. Sums of whole values are 64-bit integers wherever
    windows' sums fit, general doubles take two passes over each window.
    """
    p = checked_length(series, m) - m + 1
    if first < 1 or last < first:
        raise ValueError("diagonals are numbered from 1, and the last is not before the first")
    ship_package(series.sparkSession)
    values, _ = centred(series, m)
    top, size = centre(series)[1], max(size, last)  # the halo is no longer than the block
    whole = top is not None and m * m * top * top < 2**62 and top < 2**53

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in enumerate(batch.column(0).to_pylist()):
                a = batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                for diag in range(first, last + 1):
                    rows = min(size, p - b * size - diag)
                    if rows > 0:
                        r = on_diagonal(a, diag, rows, m, whole)
                        ok = np.flatnonzero(np.isfinite(r))
                        i = ok + b * size
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(i + diag), pa.array(r[ok])], names=["i", "j", "r"])

    return blocks(values, m + last, size, (p - 1) // size).mapInArrow(run, "i bigint, j bigint, r double")


# --- broadcast ----------------------------------------------------------------------------


def squares(p: int, size: int, cores: int) -> tuple[int, int]:
    """Squares a side, and tiles a square's side, for ``p`` windows: about four tasks a core, more beyond ``SIDE_VALUES``."""
    k = -(-p // size)
    side = min(-(-k // max(1, round((8 * cores) ** 0.5))), max(1, SIDE_VALUES // size))
    return -(-k // side), side


def square_of(task: int, g: int) -> tuple[int, int]:
    """Row and column of a task in the triangle of squares, row by row: rows hold g, g - 1, ... squares."""
    left = g * (g + 1) // 2 - 1 - task  # squares after it; rows from the end hold 1, 2, ...
    row = g - 1 - (isqrt(8 * left + 1) - 1) // 2
    return row, task - row * g + row * (row - 1) // 2 + row


def _square(block, row: int, column: int, side: int, size: int, p: int, m: int, band: int, exact: bool, half: str, since: int = 0, keep=None, counters: bool = False) -> Iterator[pa.RecordBatch]:
    """All tiles of a square; ``block(b)`` gives the values of a block with its halo.

    ``counters`` adds a row at position -1 with the cells evaluated (as ``r``) and
    the updates of a best partner (as ``nn``).
    """
    columns: dict[int, Best] = {}
    evaluated, updates = 0, 0
    last = -(-p // size) - 1
    for t in range(row * side, min((row + 1) * side - 1, last) + 1):
        mine = Best(t * size, min(size, p - t * size))
        for u in range(max(t, column * side), min((column + 1) * side - 1, last) + 1):
            if (u + 1) * size <= since or keep is not None and not keep(t, u):
                continue
            if u not in columns:
                columns[u] = Best(u * size, min(size, p - u * size))
            tile(block(t), block(u), t * size, u * size, m, band, exact, mine, columns[u], half)
            evaluated += cells(t * size, len(mine.r), u * size, len(columns[u].r), band)
        updates += mine.updates
        yield from _out([mine])
    yield from _out(columns.values())
    if counters:
        updates += sum(b.updates for b in columns.values())
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([float(evaluated)]), pa.array([updates])], schema=_ARROW)


def partial_broadcast(series: DataFrame, m: int, band: int, size: int = TILE, half: str = "both", fraction: float = 1.0, seed: int = 0, since: int = 0, counters: bool = False) -> DataFrame:
    """Partial profile from the whole series on every executor.

    ``fraction`` below 1 runs a random part of the tiles (by digest of the seed
    and the tile's row and column): an early approximation.
    ``since`` leaves out tiles whose columns all lie below that position: what
    an earlier run over a shorter series has covered.
    """
    n = checked_length(series, m)
    spark, p = series.sparkSession, n - m + 1
    values, exact = collect_values(series, n, m)
    shared = spark.sparkContext.broadcast(values)
    g, side = squares(p, size, spark.sparkContext.defaultParallelism)
    tasks = g * (g + 1) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        block = lambda b: a[b * size : min((b + 1) * size, p) + m - 1]
        keep = None if fraction >= 1 else lambda t, u: draw(seed, t, u) < fraction
        for batch in batches:
            for task in batch.column(0).to_pylist():
                yield from _square(block, *square_of(task, g), side, size, p, m, band, exact, half, since, keep, counters)

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, _PARTIAL)


# --- shuffle ------------------------------------------------------------------------------


def blocks(values: DataFrame, m: int, size: int, last: Column | int, *keys: str) -> DataFrame:
    """``b, a`` (by key): centred values ``v`` of each block up to number ``last`` with its halo of ``m - 1``, as one array; NaN where missing."""
    own, back = F.expr(f"pos div {size}"), (size + m - 2) // size  # a value is in its own block and in so many before
    rows = values.select(*keys, "pos", "v", F.explode(F.sequence(F.greatest(F.lit(0), own - back), F.least(own, last if isinstance(last, Column) else F.lit(last)))).alias("b"))
    rows = rows.filter(F.col("pos") < (F.col("b") + 1) * size + m - 1)
    whole = rows.groupBy(*keys, "b").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("v", F.lit(float("nan"))).alias("v")))).alias("a"))
    return whole.select(*keys, "b", F.col("a.v").alias("a"))


def partial_squares(blocked: DataFrame, m: int, band: int, size: int, tasks: int, half: str = "both", since: int = 0) -> DataFrame:
    """``key, pos, r, nn`` from blocks ``key, b, a`` of one or many series; no task holds a series.

    Each block also has its series' number of windows ``p``, tiles a square's
    side ``side``, squares a side ``g`` and ``exact``. It goes to the ``g`` squares of its row and
    column; a square's blocks arrive together and are held while its tiles run:
    twice a square's side of values, whatever the series' length. ``tasks`` is
    the number of squares of all series; ``since`` leaves out what lies below that
    column.
    """
    ship_package(blocked.sparkSession)
    kind = blocked.schema["key"].dataType
    own, other = F.expr("b div side"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1)).alias("other")
    sent = blocked.select("key", own.alias("own"), other, "b", "a", "p", "side", "exact")
    sent = sent.select("key", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), "b", "a", "p", "side", "exact")
    if since:
        sent = sent.filter((F.col("col") + 1) * F.col("side") * size > since)
    placed = sent.repartitionByRange(min(tasks, MOST_PARTITIONS), "key", "row", "col").sortWithinPartitions("key", "row", "col", "b")
    schema = pa.schema([("key", to_arrow_type(kind)), *_ARROW])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def finish():
            key, row, column, p, side, exact = now
            for out in _square(held.__getitem__, row, column, side, size, p, m, band, exact, half, since):
                yield pa.RecordBatch.from_arrays([pa.array([key] * out.num_rows, schema.field("key").type), *out.columns], schema=schema)

        for batch in batches:
            own = list(zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 5, 6, 7)]))
            for k, (square, b) in enumerate(zip(own, batch.column(3).to_pylist())):
                if square != now:
                    if now is not None:
                        yield from finish()
                    now, held = square, {}
                held[b] = batch.column(4)[k].values.to_numpy(zero_copy_only=False).copy()
        if now is not None:
            yield from finish()

    return placed.mapInArrow(run, f"key {kind.simpleString()}, {_PARTIAL}")


def partial_shuffle(series: DataFrame, m: int, band: int, size: int = TILE, half: str = "both", since: int = 0) -> DataFrame:
    """Partial profile from blocks sent to the squares that need them; ``since`` as for broadcast."""
    p = checked_length(series, m) - m + 1
    values, exact = centred(series, m)
    g, side = squares(p, size, series.sparkSession.sparkContext.defaultParallelism)
    own = blocks(values, m, size, (p - 1) // size).select(F.lit(0).alias("key"), "b", "a", *[F.lit(x).cast("bigint").alias(c) for c, x in (("p", p), ("side", side), ("g", g))], F.lit(exact).alias("exact"))
    return partial_squares(own, m, band, size, g * (g + 1) // 2, half, since).drop("key")


# --- the tiles that copies leave ----------------------------------------------------------


def wanted(rest: list[int], last: int, half: str, cores: int, size: int) -> tuple[list[list[int]], list[list[int]]]:
    """Groups of the blocks ``rest``, whose windows need a search, and of the blocks that they meet: a task for each pair of groups."""
    others = list(range(min(rest) if half == "right" else 0, (max(rest) if half == "left" else last) + 1))
    tasks, most = 8 * cores, max(1, SIDE_VALUES // size)
    rows = min(len(rest), max(1, round((tasks * len(rest) / len(others)) ** 0.5), -(-len(rest) // most)))
    columns = min(len(others), max(-(-tasks // rows), -(-len(others) // most)))
    # dealt out in turn: with halves, the tasks of one run of blocks would have all the work and others none
    return [rest[k::rows] for k in range(rows)], [others[k::columns] for k in range(columns)]


def _group(block, mine: list[int], others: list[int], rest: set[int], size: int, p: int, m: int, band: int, exact: bool, half: str, keep=None) -> Iterator[pa.RecordBatch]:
    """The tiles of two groups of blocks; those between two blocks of ``rest`` are evaluated once."""
    held: dict[int, Best] = {}
    for x in mine:
        for y in others:
            if (half == "left" and y > x) or (half == "right" and y < x) or (half == "both" and y < x and y in rest):
                continue
            t, u = min(x, y), max(x, y)
            if keep is not None and not keep(t, u):
                continue
            for b in (t, u):
                if b not in held:
                    held[b] = Best(b * size, min(size, p - b * size))
            # a tile on the diagonal folds rows and columns of the same block
            tile(block(t), block(u), t * size, u * size, m, band, exact, held[t], held[u], half)
    yield from _out(held.values())


def partial_rest(series: DataFrame, m: int, band: int, size: int, rest: list[int], strategy: str, half: str = "both", keep=None) -> DataFrame:
    """Partial profile with every pair of the windows of the blocks ``rest``; the others' rows are true pairs, but not all."""
    spark, n = series.sparkSession, checked_length(series, m)
    if not rest:
        return spark.createDataFrame([], _PARTIAL)
    p = n - m + 1
    rows, columns = wanted(rest, (p - 1) // size, half, spark.sparkContext.defaultParallelism, size)
    tasks, there = len(rows) * len(columns), set(rest)
    if strategy == "broadcast":
        values, exact = collect_values(series, n, m)
        shared = spark.sparkContext.broadcast(values)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = shared.value
            block = lambda b: a[b * size : min((b + 1) * size, p) + m - 1]
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    yield from _group(block, rows[task // len(columns)], columns[task % len(columns)], there, size, p, m, band, exact, half, keep)

        return spark.range(0, tasks, 1, tasks).mapInArrow(run, _PARTIAL)
    values, exact = centred(series, m)
    sent = {(b, r * len(columns) + c) for r, g in enumerate(rows) for b in g for c in range(len(columns))}
    sent |= {(b, r * len(columns) + c) for c, g in enumerate(columns) for b in g for r in range(len(rows))}
    where = spark.createDataFrame(sorted(sent), "b bigint, task bigint")
    placed = blocks(values, m, size, (p - 1) // size).join(F.broadcast(where), "b").select("task", "b", "a")
    placed = placed.repartitionByRange(min(tasks, MOST_PARTITIONS), "task").sortWithinPartitions("task", "b")

    def by_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        finish = lambda: _group(held.__getitem__, rows[now // len(columns)], columns[now % len(columns)], there, size, p, m, band, exact, half, keep)
        for batch in batches:
            for k, (task, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if task != now:
                    if now is not None:
                        yield from finish()
                    now, held = task, {}
                held[b] = batch.column(2)[k].values.to_numpy(zero_copy_only=False).copy()
        if now is not None:
            yield from finish()

    return placed.mapInArrow(by_task, _PARTIAL)


def copied(series: DataFrame, m: int, band: int, size: int, half: str = "both", early: tuple[int, float, int] | None = None) -> tuple[DataFrame, list[int]] | None:
    """What the windows' copies settle, and the blocks left (``copies.settled``); nothing for short series and general doubles."""
    p = checked_length(series, m) - m + 1
    values, exact = centred(series, m)
    if p < COPIES_FROM or not exact:
        return None
    own = blocks(values, m, size, (p - 1) // size)
    return copies.settled(own, m, band, size, half, early)


def partial_early(series: DataFrame, m: int, band: int, size: int, fraction: float, seed: int) -> DataFrame:
    """Partial profile of a random part of the tiles (as ``partial_broadcast`` takes it), of a series of any length."""
    n = checked_length(series, m)
    found, strategy = copied(series, m, band, size, early=(size, fraction, seed)), "broadcast" if n <= BROADCAST_VALUES else "shuffle"
    if found is None and strategy == "broadcast":
        return partial_broadcast(series, m, band, size, fraction=fraction, seed=seed)
    keep = lambda t, u: draw(seed, t, u) < fraction
    if found is None:
        return partial_rest(series, m, band, size, list(range(-(-(n - m + 1) // size))), strategy, keep=keep)
    return found[0].unionByName(partial_rest(series, m, band, size, found[1], strategy, keep=keep))


# --- the query ----------------------------------------------------------------------------


def partial_profile(series: DataFrame, m: int, strategy: str = "auto", exclusion: int | None = None, tile_size: int = TILE, half: str = "both") -> DataFrame:
    band = default_band(m) if exclusion is None else exclusion
    if strategy == "auto":
        strategy = "broadcast" if checked_length(series, m) <= BROADCAST_VALUES else "shuffle"
    if strategy == "sql":
        cells = cells_sql(series, m, band)
        if half == "both":
            return both_sides(cells)
        return cells.select(F.col("j" if half == "left" else "i").alias("pos"), "r", F.col("i" if half == "left" else "j").alias("nn"))
    if strategy not in ("broadcast", "shuffle"):
        raise ValueError(f"no strategy {strategy!r}; there are auto, sql, broadcast and shuffle")
    found = copied(series, m, band, tile_size, half)
    if found is not None and 2 * len(found[1]) < -(-(checked_length(series, m) - m + 1) // tile_size):
        return found[0].unionByName(partial_rest(series, m, band, tile_size, found[1], strategy, half))
    plan = partial_broadcast if strategy == "broadcast" else partial_shuffle
    return plan(series, m, band, tile_size, half)


def window_positions(series: DataFrame, m: int) -> DataFrame:
    """Every position that starts a window."""
    return series.select("pos").filter(F.col("pos") <= checked_length(series, m) - m)


def matrix_profile(series: DataFrame, m: int, strategy: str = "auto", exclusion: int | None = None, tile_size: int = TILE, squared: bool = False, half: str = "both") -> DataFrame:
    """``pos, dist, nn``: for every window its nearest window with ``|i - j| > exclusion`` (default ``m // 4``)."""
    partial = partial_profile(series, m, strategy, exclusion, tile_size, half)
    return finished(best(partial), window_positions(series, m), m, squared)


def counted_profile(series: DataFrame, m: int, exclusion: int | None = None, tile_size: int = TILE) -> tuple[DataFrame, Observation]:
    """The profile by broadcast, and an observation that has its counters once the profile has been read.

    Counters: ``cells`` evaluated, ``updates`` of a best partner inside the tasks,
    ``partial_rows`` that the tasks sent.
    """
    band = default_band(m) if exclusion is None else exclusion
    seen = Observation("profile counters")
    partial = partial_broadcast(series, m, band, tile_size, counters=True)
    mark = F.col("pos") < 0
    partial = partial.observe(seen, F.coalesce(F.sum(F.when(mark, F.col("r"))), F.lit(0.0)).cast("bigint").alias("cells"), F.coalesce(F.sum(F.when(mark, F.col("nn"))), F.lit(0)).alias("updates"), F.count(F.when(~mark, 1)).alias("partial_rows"))
    return finished(best(partial.filter(~mark)), window_positions(series, m), m), seen
