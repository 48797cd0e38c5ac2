"""Profiles: partial results, merging, halves, comparison, motifs and discords.

A partial profile is ``pos, r, nn`` (correlation and neighbour; more rows for a
position are fine). A profile is ``pos, dist, nn`` with one row a position.
Ties: the highest correlation, then the least neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifgrid.functions.expressions import correlation_to_dist, correlation_to_dist2


def both_sides(cells: DataFrame) -> DataFrame:
    """Cells ``i, j, r`` seen from the row and from the column."""
    return cells.select(F.inline(F.array(F.struct(F.col("i").alias("pos"), F.col("r"), F.col("j").alias("nn")), F.struct(F.col("j").alias("pos"), F.col("r"), F.col("i").alias("nn")))))


def best(partial: DataFrame, *keys: str) -> DataFrame:
    """One row a position (and key): the best of the partial rows; aggregates before the shuffle."""
    top = partial.groupBy(*keys, "pos").agg(F.max(F.struct("r", (-F.col("nn")).alias("less"))).alias("t"))
    return top.select(*keys, "pos", F.col("t.r").alias("r"), (-F.col("t.less")).alias("nn"))


def merge(*partials: DataFrame) -> DataFrame:
    return best(reduce(DataFrame.unionByName, partials))


def finished(partial: DataFrame, positions: DataFrame, m: int, squared: bool = False, *keys: str) -> DataFrame:
    """``pos, dist, nn`` of every position; nulls where a position has no admissible partner."""
    dist = (correlation_to_dist2 if squared else correlation_to_dist)(F.col("r"), m)
    return positions.select(*keys, "pos").join(partial, [*keys, "pos"], "left").select(*keys, "pos", dist.alias("dist"), "nn")


def left_half(cells: DataFrame) -> DataFrame:
    """Best earlier neighbour of each position, from cells with i < j."""
    return best(cells.select(F.col("j").alias("pos"), "r", F.col("i").alias("nn")))


def right_half(cells: DataFrame) -> DataFrame:
    """Best later neighbour of each position, from cells with i < j."""
    return best(cells.select(F.col("i").alias("pos"), "r", F.col("j").alias("nn")))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: differing neighbours, largest distance difference, positions on one side only."""
    a, b = left.select("pos", F.col("dist").alias("d1"), F.col("nn").alias("n1"), F.lit(1).alias("h1")), right.select("pos", F.col("dist").alias("d2"), F.col("nn").alias("n2"), F.lit(1).alias("h2"))
    both = a.join(b, "pos", "full_outer")
    paired = F.col("h1").isNotNull() & F.col("h2").isNotNull()
    return both.agg(
        F.coalesce(F.sum(F.when(paired & ~F.col("n1").eqNullSafe(F.col("n2")), 1)), F.lit(0)).cast("bigint").alias("n_diff"),
        F.coalesce(F.max(F.when(paired, F.abs(F.col("d1") - F.col("d2")))), F.lit(0.0)).alias("max_abs_diff"),
        F.count(F.when(F.col("h2").isNull(), 1)).alias("n_only_left"),
        F.count(F.when(F.col("h1").isNull(), 1)).alias("n_only_right"),
    )


def validate(results: dict[str, DataFrame], baseline: str) -> DataFrame:
    """``algo, n_positions, n_diff, max_abs_diff`` of each result against the baseline."""
    rows = []
    for name, r in results.items():
        if name != baseline:
            base = results[baseline].select("pos", F.lit(0).alias("side"), "dist", "nn").unionByName(r.select("pos", F.lit(1).alias("side"), "dist", "nn"))
            at = base.groupBy("pos").agg(*[F.max(F.when(F.col("side") == k, F.struct("dist", "nn"))).alias(f"s{k}") for k in (0, 1)])
            both = F.col("s0").isNotNull() & F.col("s1").isNotNull()
            rows.append(
                at.agg(
                    F.count("s1").alias("n_positions"),
                    F.count(F.when(both & ~F.col("s0.nn").eqNullSafe(F.col("s1.nn")), 1)).alias("n_diff"),
                    F.coalesce(F.max(F.when(both, F.abs(F.col("s0.dist") - F.col("s1.dist")))), F.lit(0.0)).alias("max_abs_diff"),
                ).select(F.lit(name).alias("algo"), "n_positions", "n_diff", "max_abs_diff")
            )
    return reduce(DataFrame.unionByName, rows)


def named_runs(files: DataFrame) -> DataFrame:
    """``file, config, algo, procs, n, m`` of result files, from names like ``matprof_v<id>_l<n>m<m>...alg#<name>#..._p<ranks>_...``."""
    named = files.select(
        "file",
        F.regexp_extract("file", r"matprof_v(.*?_l\d+m\d+)", 1).alias("config"),
        F.regexp_extract("file", r"alg#([^#]*)#", 1).alias("algo"),
        F.regexp_extract("file", r"_p(\d+)_", 1).alias("procs"),
        F.regexp_extract("file", r"_l(\d+)m\d+", 1).alias("n"),
        F.regexp_extract("file", r"_l\d+m(\d+)", 1).alias("m"),
    )
    return named.filter("config <> ''")


def pair_runs(files: DataFrame, baselines: Sequence[str] = ("sampled_exact", "sequential")) -> DataFrame:
    """Result files to compare: ``config, baseline, other, algo, procs, by_baseline``.

    The baseline is the first file of the first algorithm in ``baselines`` that
    there is; a configuration without any compares each file with the one before.
    """
    known = F.array(*[F.lit(x) for x in baselines])
    rank = F.when(F.array_contains(known, F.col("algo")), F.array_position(known, F.col("algo"))).otherwise(len(baselines) + 1)
    own = Window.partitionBy("config")
    ranked = named_runs(files).withColumn("rank", rank)
    ranked = ranked.select("*", F.min(F.struct("rank", "file")).over(own).alias("top"), F.lag("file").over(own.orderBy("file")).alias("prior"))
    by = F.col("top.rank") <= len(baselines)
    chosen = ranked.select("config", F.when(by, F.col("top.file")).otherwise(F.col("prior")).alias("baseline"), F.col("file").alias("other"), "algo", "procs", by.alias("by_baseline"))
    return chosen.filter("baseline IS NOT NULL AND baseline <> other")


def motifs(profile: DataFrame, k: int) -> DataFrame:
    """The k positions nearest to their neighbour."""
    return profile.filter("dist IS NOT NULL").orderBy("dist", "pos").limit(k)


def discords(profile: DataFrame, k: int) -> DataFrame:
    """The k positions farthest from their neighbour."""
    return profile.filter("dist IS NOT NULL").orderBy(F.desc("dist"), "pos").limit(k)
