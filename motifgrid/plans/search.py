"""Similarity search: one query window against all windows of a series.

Blocks of the series (with a halo) are correlated with the query by Fourier
transforms, so a block of B values costs O(B log B) for any window length; the
query alone goes to every task. Exact whole-valued series come out exact: where
the transform's rounding is below a quarter for sure, dot products are rounded
back, else they are summed as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifgrid.functions.expressions import correlation_to_dist
from motifgrid.storage import ship_package

from .kernel import centred_stats, correlate, exact_bound, sliding, stats
from .strategies import blocks, centre, centred, checked_length, default_band

BLOCK = 1 << 15


def sliding_dots(query: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Dot products of the query with every window of the values, by convolution with the reversed query."""
    m, n = len(query), len(values)
    if n < m:
        return np.zeros(0)
    size = 1 << (n + m - 1).bit_length()
    spectrum = np.fft.rfft(values, size) * np.fft.rfft(query[::-1], size)
    return np.fft.irfft(spectrum, size)[m - 1 : n]


def transform_is_exact(m: int, block: int, top: float, query_top: float) -> bool:
    """Whether a block's transform rounds dot products of whole numbers by less than a quarter: a few eps * log2(s) times both sides' norms."""
    size = 1 << (block + 2 * m).bit_length()
    return 8 * 2.0**-52 * np.log2(size) * np.sqrt(size * m) * max(1.0, top) * max(1.0, query_top) < 0.25


def first_dots(series: DataFrame, m: int, block: int = BLOCK) -> DataFrame:
    """``diag, dot``: dot product of the first window with every window, the first cell of each diagonal; whole values, nulls count as zero."""
    n = series.agg(F.max("pos")).first()[0]
    if n is None or n + 1 < m:
        return series.sparkSession.createDataFrame([], "diag bigint, dot bigint")
    ship_package(series.sparkSession)
    middle, top = centre(series)
    head = {r["pos"]: r["c"] for r in series.filter(F.col("pos") < m).collect()}  # m rows
    q = np.array([(head[k] if head.get(k) is not None else 0) - middle for k in range(m)], np.int64)
    zeroed = series.select("pos", F.coalesce("c", F.lit(0)).alias("c"))
    values = zeroed.select("pos", (F.col("c") - F.lit(middle)).cast("double").alias("v"))
    most = float(max(top, abs(middle), int(np.abs(q).max())))
    if most >= 2**53:
        raise ValueError("values too far from their middle for exact products")
    near = transform_is_exact(m, block, most, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in enumerate(batch.column(0).to_pylist()):
                x = batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                whole = x.astype(np.int64)
                dot = np.rint(sliding_dots(q.astype(float), x)).astype(np.int64) if near else np.lib.stride_tricks.sliding_window_view(whole, m) @ q
                dot += middle * (sliding(whole, m) + int(q.sum())) + m * middle * middle  # back from the centred values
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(dot)) + b * block), pa.array(dot)], names=["diag", "dot"])

    return blocks(values, m, block, (n + 1 - m) // block).mapInArrow(run, "diag bigint, dot bigint")


def search(series: DataFrame, query: list, block: int = BLOCK) -> DataFrame:
    """``pos, r``: correlation of the query with every window that has no missing value."""
    m = len(query)
    n = checked_length(series, m)
    ship_package(series.sparkSession)
    values, exact = centred(series, m)
    middle, top = centre(series)
    q = np.array([v - middle for v in query], float)  # whole numbers are subtracted as such
    whole = exact and bool((q == np.round(q)).all()) and exact_bound(m, max(top, int(np.abs(q).max())))
    near = whole and transform_is_exact(m, block, top, float(np.abs(q).max()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = stats if whole else centred_stats
        s_q, d_q = of(q, m)
        for batch in batches:
            for k, b in enumerate(batch.column(0).to_pylist()):
                x = batch.column(1)[k].values.to_numpy(zero_copy_only=False)
                s, d = of(x, m)
                if whole and not near:
                    dot = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(x), m) @ q
                else:
                    dot = sliding_dots(q, np.nan_to_num(x))
                r = correlate((np.rint(dot) if near else dot)[None, :].copy(), m, s_q, d_q, s, d)[0]
                ok = np.isfinite(r)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(ok) + b * block), pa.array(r[ok])], names=["pos", "r"])

    return blocks(values, m, block, (n - m) // block).mapInArrow(run, "pos bigint, r double")


def distance_row(series: DataFrame, row: int, m: int, exclusion: int | None = None, block: int = BLOCK) -> DataFrame:
    """``pos, dist``: the distances of the window at ``row`` from all windows at ``exclusion`` positions or more from it."""
    apart = max(1, default_band(m) if exclusion is None else exclusion)
    values = series.filter(F.col("pos").between(row, row + m - 1)).orderBy("pos").collect()  # m rows
    if len(values) < m:
        raise ValueError(f"no window starts at {row}")
    if any(r[1] is None for r in values):
        return series.sparkSession.createDataFrame([], "pos bigint, dist double")  # a window with a null has no distances
    found = search(series, [r[1] for r in values], block)
    return found.filter(F.abs(F.col("pos") - row) >= apart).select("pos", correlation_to_dist(F.col("r"), m).alias("dist"))
