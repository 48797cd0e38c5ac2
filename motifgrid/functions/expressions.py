"""Scalar expressions of z-normalised window similarity, as Spark columns.

A window's score is ``m`` times its Pearson correlation with another window;
``dist2 = 2m - 2 score`` is the squared z-normalised Euclidean distance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_to_dist2(score: Column, m: int) -> Column:
    return F.lit(2.0 * m) - 2 * score


def dist2_to_dist(dist2: Column) -> Column:
    """Tiny negative squares (rounding) count by their size."""
    return F.sqrt(F.abs(dist2))


def correlation_to_dist2(r: Column, m: int) -> Column:
    """Null where there is no correlation (``greatest`` alone would skip the null)."""
    return F.when(r.isNotNull(), F.greatest(F.lit(0.0), F.lit(2.0 * m) * (1 - r)))


def correlation_to_dist(r: Column, m: int) -> Column:
    return F.sqrt(correlation_to_dist2(r, m))


def dot_from_dist2(dist2: Column, mean_i: Column, sd_i: Column, mean_j: Column, sd_j: Column, m: int) -> Column:
    """The dot product that gives a squared distance: the inverse of the distance formula."""
    return (F.lit(float(m)) - dist2 / 2) * sd_i * sd_j + F.lit(float(m)) * mean_i * mean_j


def direct_dist2(dot: Column, mean_i: Column, sd_i: Column, mean_j: Column, sd_j: Column, m: int) -> Column:
    return 2 * (F.lit(float(m)) - (dot - F.lit(float(m)) * mean_i * mean_j) / (sd_i * sd_j))


def factored_score(dot: Column, inv_sd_i: Column, inv_sd_j: Column, scaled_mean_i: Column, scaled_mean_j: Column) -> Column:
    return dot * (inv_sd_i * inv_sd_j) - scaled_mean_i * scaled_mean_j


def exact_sd(m: int, s: Column, q: Column) -> Column:
    """``m`` times the population standard deviation, from the sums of values and squares."""
    return F.sqrt((F.lit(m) * q - s * s).cast("double"))


def exact_correlation(m: int, dot: Column, s_i: Column, sd_i: Column, s_j: Column, sd_j: Column) -> Column:
    """Pearson correlation from sums; two constant windows agree fully, one constant window not at all."""
    plain = (F.lit(m) * dot - s_i * s_j).cast("double") / (sd_i * sd_j)
    return F.when((sd_i == 0) & (sd_j == 0), F.lit(1.0)).when((sd_i == 0) | (sd_j == 0), F.lit(0.0)).otherwise(plain)
