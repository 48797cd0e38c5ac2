"""Synthetic series with planted motifs.

A random walk (or noise) in which each of several random shapes is planted a
given number of times, each time rescaled and with noise on it. All draws are
digests of seed and place (``draw``, and the same as a column, ``uniform``), so the
series is the same however it is partitioned, and SQL can make it again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AMPLITUDE, MOTIF_AMPLITUDE, NOISE_AMPLITUDE, SCALES = 100.0, 100.0, 10.0, (0.5, 1.5)
SEED = 12341234
#: Chance that a random list of motifs goes on with another motif rather than a further embedding.
ANOTHER = 0.4
_BLOCK = 65_536


def draw(*keys) -> float:
    """A number in [0, 1) from the first 52 bits of the keys' digest."""
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 2**52


def uniform(*keys: Column | str | int) -> Column:
    """A number in [-0.5, 0.5) by the same digest."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52)) - 0.5


def choose_places(n: int, length: int, embeddings: list[int], seed: int = SEED) -> list[tuple[int, int, float]]:
    """``(motif, position, scale)`` of each embedding, in order of position; no two overlap.

    Every stretch between embeddings (and before the first and after the last)
    has a random weight and gets its share of the free positions; the motifs'
    copies come in the order of their digests.
    """
    copies = [(motif, copy) for motif, many in enumerate(embeddings) for copy in range(many)]
    if length < 1 or min(embeddings, default=1) < 1:
        raise ValueError("motifs have a length and are embedded once at least")
    free = n - len(copies) * length
    if free < 0:
        raise ValueError(f"{len(copies)} embeddings of {length} values don't fit into {n}")
    copies.sort(key=lambda c: draw(seed, "copy", *c))
    weights = [draw(seed, "gap", k) for k in range(len(copies) + 1)]
    whole, before, out = sum(weights), 0.0, []
    for k, (motif, _) in enumerate(copies):
        before += weights[k]
        out.append((motif, int(free * (before / whole)) + k * length, SCALES[0] + (SCALES[1] - SCALES[0]) * draw(seed, "scale", k)))
    return out


def choose_embeddings(n: int, length: int, seed: int = SEED) -> list[int]:
    """A random number of motifs with random multiplicities that cover half of the series at most.

    The embeddings are a row of 2 or more; between any two the row is cut by
    chance, and each part is a motif.
    """
    most = n // (2 * length)
    if most < 2:
        raise ValueError("the series is too short for two embeddings")
    many = 2 + int(draw(seed, "many") * (most - 1))
    cuts = [k for k in range(1, many) if draw(seed, "cut", k) < ANOTHER]
    return [b - a for a, b in zip([0, *cuts], [*cuts, many])]


def places_table(spark: SparkSession, places: list[tuple[int, int, float]]) -> DataFrame:
    """``motif, start, scale``."""
    return spark.createDataFrame(places, "motif int, start bigint, scale double")


def generate(spark: SparkSession, n: int, length: int = 0, embeddings: list[int] | None = None, kind: str = "walk", seed: int = SEED) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """``pos, value`` and the places of the planted motifs."""
    if kind not in ("walk", "noise"):
        raise ValueError(f"no kind {kind!r}; there are walk and noise")
    places = choose_places(n, length, embeddings, seed) if embeddings else []
    rows = spark.range(n).select(F.col("id").alias("pos"))
    delta = uniform(seed, "step", F.col("pos")) * AMPLITUDE
    if places:
        table = places_table(spark, places)
        inside = table.select("motif", "scale", F.explode(F.sequence("start", F.col("start") + length - 1)).alias("pos"), "start")
        rows = rows.join(F.broadcast(inside) if len(places) * length < 1_000_000 else inside, "pos", "left")
        shape = uniform(seed, "shape", F.col("motif"), F.col("pos") - F.col("start")) * MOTIF_AMPLITUDE
        delta = F.when(F.col("motif").isNull(), delta).otherwise(shape * F.col("scale") + uniform(seed, "noise", F.col("pos")) * NOISE_AMPLITUDE)
    steps = rows.select("pos", delta.alias("d"), F.expr(f"pos div {_BLOCK}").alias("b"))
    if kind == "noise":
        return steps.select("pos", F.col("d").alias("value")), places
    inside = steps.withColumn("run", F.sum("d").over(Window.partitionBy("b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    base = steps.groupBy("b").agg(F.sum("d").alias("t")).select("b", F.coalesce(F.sum("t").over(below), F.lit(0.0)).alias("base"))
    return inside.join(base, "b").select("pos", (F.col("run") + F.col("base")).alias("value")), places
