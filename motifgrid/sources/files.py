"""Series and profile files by format, and conversions between formats.

Text series are doubles separated by white space; text profiles have a line
``<dist> <neighbour>`` for each position. Binary profiles hold the squared
distance, text profiles its root. A token that isn't a number is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifgrid.functions.expressions import dist2_to_dist
from motifgrid.operators import profiles
from motifgrid.storage import names_in

from .binary import read_binary, read_header, write_binary


def format_of(path: str, fmt: str = "by_suffix") -> str:
    """``ascii`` or ``bin``, from the name's end unless given."""
    if fmt in ("ascii", "bin"):
        return fmt
    if fmt != "by_suffix":
        raise ValueError(f"no format {fmt!r}; there are ascii, bin and by_suffix")
    for end in ("ascii", "bin"):
        if path.rstrip("/").endswith(f".{end}"):
            return end
    raise ValueError(f"{path}: the format can't be told from the name")


def output_name(strategy: str, m: int, path: str, fmt: str) -> str:
    """Default name of a result file."""
    return f"{strategy}_{m}_{path.rstrip('/').rpartition('/')[2]}.matprof.{fmt}"


def read_series(spark: SparkSession, path: str, fmt: str = "by_suffix", **options) -> DataFrame:
    """``pos, value``."""
    if format_of(path, fmt) == "bin":
        return read_binary(spark, path, "series", **options)
    tokens = spark.read.text(path, wholetext=True).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("t"))
    rows = tokens.select(F.posexplode("t").alias("pos", "token")).filter("token <> ''")
    return rows.select(F.col("pos").cast("bigint").alias("pos"), F.col("token").cast("double").alias("value"))


def series_length(spark: SparkSession, path: str, fmt: str = "by_suffix") -> int:
    """From the header of a binary file, else counted."""
    return read_header(path, "series") if format_of(path, fmt) == "bin" else read_series(spark, path, fmt).count()


def write_series(df: DataFrame, path: str, fmt: str = "by_suffix", mode: str = "append", chunk_rows: int = 0) -> None:
    """Store ``pos, value``; ``chunk_rows`` bounds the rows that a binary writer takes at once."""
    if format_of(path, fmt) == "bin":
        return write_binary(df, path, "series", mode, chunk_rows)
    lines = df.orderBy("pos").select(F.col("value").cast("double").cast("string").alias("value"))
    lines.coalesce(1).write.mode("overwrite" if mode == "overwrite" else "errorifexists").text(path)


def read_profile(spark: SparkSession, path: str, fmt: str = "by_suffix", **options) -> DataFrame:
    """``pos, dist, nn``; a position without neighbour has nulls."""
    if format_of(path, fmt) == "bin":
        return read_binary(spark, path, "profile", **options).select("pos", dist2_to_dist(F.col("dist2")).alias("dist"), "nn")
    lines = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), r"\s*\n\s*").alias("l"))
    rows = lines.select(F.posexplode("l").alias("pos", "line")).filter("line <> ''").select(F.col("pos").cast("bigint").alias("pos"), F.split("line", " ").alias("f"))
    nn = F.col("f")[1].cast("bigint")
    return rows.select("pos", F.when(nn >= 0, F.col("f")[0].cast("double")).alias("dist"), F.when(nn >= 0, nn).alias("nn"))


def write_profile(df: DataFrame, path: str, fmt: str = "by_suffix", mode: str = "append", chunk_rows: int = 0) -> None:
    """Store ``pos, dist, nn``; binary files get the square of the distance."""
    if format_of(path, fmt) == "bin":
        return write_binary(df.select("pos", (F.col("dist") * F.col("dist")).alias("dist2"), "nn"), path, "profile", mode, chunk_rows)
    line = F.concat_ws(" ", F.coalesce(F.col("dist").cast("string"), F.lit("Infinity")), F.coalesce("nn", F.lit(-1)).cast("string"))
    df.orderBy("pos").select(line.alias("value")).coalesce(1).write.mode("overwrite" if mode == "overwrite" else "errorifexists").text(path)


def other_format(path: str, fmt: str = "by_suffix") -> tuple[str, str]:
    """Where a converted file goes by default, and its format: the same name with the other end."""
    end = "ascii" if format_of(path, fmt) == "bin" else "bin"
    stem = path.rstrip("/")
    for known in (".ascii", ".bin"):
        stem = stem.removesuffix(known)
    return f"{stem}.{end}", end


def convert_series(spark: SparkSession, source: str, target: str = "", mode: str = "append", fmt: str = "by_suffix", target_fmt: str = "by_suffix") -> str:
    """Between text and binary, by the formats or the names' ends; returns the target (default: the other end)."""
    if not target:
        target, target_fmt = other_format(source, fmt)
    write_series(read_series(spark, source, fmt), target, target_fmt, mode)
    return target


def convert_profile(spark: SparkSession, source: str, target: str = "", mode: str = "append", fmt: str = "by_suffix", target_fmt: str = "by_suffix") -> str:
    if not target:
        target, target_fmt = other_format(source, fmt)
    write_profile(read_profile(spark, source, fmt), target, target_fmt, mode)
    return target


def validate_folder(spark: SparkSession, folder: str, need_baseline: bool = False) -> tuple[DataFrame, dict]:
    """Compare the result files of a folder: one row for each pair (see ``profiles.pair_runs``), and a summary of all.

    A configuration with one file only, or without a baseline algorithm where
    one is needed, is an error.
    """
    runs = spark.createDataFrame([(n,) for n in names_in(spark, folder) if n.startswith("matprof_v")], "file string")
    pairs = profiles.pair_runs(runs)
    named = profiles.named_runs(runs)
    alone = named.groupBy("config").agg(F.count("*").alias("n")).filter("n < 2").select("config").collect()
    if alone:
        raise ValueError(f"nothing to compare with: {', '.join(r['config'] for r in alone)}")
    chosen = pairs.orderBy("config", "other").collect()  # names of files
    if need_baseline and (lost := sorted({r["config"] for r in chosen if not r["by_baseline"]})):
        raise ValueError(f"no baseline result: {', '.join(lost)}")
    if not chosen:
        raise ValueError(f"{folder} has no result files")
    rows = []
    for r in chosen:
        compared = profiles.compare(*[read_profile(spark, f"{folder.rstrip('/')}/{r[side]}") for side in ("baseline", "other")]).first()
        rows.append((r["config"], r["baseline"], r["other"], *compared))
    table = spark.createDataFrame(rows, "config string, baseline string, other string, n_diff bigint, max_abs_diff double, n_only_left bigint, n_only_right bigint")
    facts = named.agg(F.count("*"), F.countDistinct("config"), *[F.array_sort(F.collect_set(c)) for c in ("algo", "procs", "n", "m")]).first()
    summary = dict(zip(("files", "configs", "algorithms", "process_counts", "lengths", "windows"), facts))
    summary |= {"pairs": len(rows), "differences": sum(r[3] + r[5] + r[6] for r in rows), "max_abs_diff": max(r[4] for r in rows)}
    return table, summary
