"""Command line: ``profile``, ``convert``, ``generate``, ``compare``, ``validate`` and ``next-count``.

    python -m motifgrid profile --strategy broadcast --window 64 --input s.bin [--output p.bin]
    python -m motifgrid profile --strategy sampled --stride 0.25 --window 64 --input s.ascii
    python -m motifgrid convert series s.ascii s.bin
    python -m motifgrid convert profile p.bin
    python -m motifgrid generate out.ascii 10000 --length 100 --embeddings 3 2
    python -m motifgrid generate out.ascii 10000 --length 100 --random
    python -m motifgrid compare a.bin b.ascii
    python -m motifgrid validate results/
    python -m motifgrid next-count 4 2 --variant square_exp
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from motifgrid.functions.timing import Phases
from motifgrid.operators.profiles import compare
from motifgrid.plans.partitioning import next_process_count
from motifgrid.plans.sampled import refined_profile, sampled_profile
from motifgrid.plans.strategies import TILE, checked_length, matrix_profile
from motifgrid.sources import files
from motifgrid.sources.generate import SEED, choose_embeddings, generate


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="motifgrid", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("profile", help="the nearest neighbour of every window")
    p.add_argument("--strategy", default="auto", choices=["auto", "sql", "broadcast", "shuffle", "sampled", "refined"])
    p.add_argument("--window", type=int, required=True, help="values of a window")
    p.add_argument("--stride", type=float, default=0.25, help="sampling step in window lengths (sampled and refined)")
    p.add_argument("--input", required=True)
    p.add_argument("--output", default="", help="result path; made from the input's name if left out")
    p.add_argument("--filetype", default="by_suffix", choices=["by_suffix", "ascii", "bin"])
    p.add_argument("--tile", type=int, default=TILE, help="windows of a tile's side")
    p.add_argument("--chunk-rows", type=int, default=0, help="rows that a binary reader or writer takes at once, 0: default")
    c = commands.add_parser("convert", help="between text and binary, by the names' ends")
    c.add_argument("kind", choices=["series", "profile"])
    c.add_argument("source")
    c.add_argument("target", nargs="?", default="", help="made from the source's name if left out")
    c.add_argument("--filetype", default="by_suffix", choices=["by_suffix", "ascii", "bin"], help="format of the source")
    c.add_argument("--target-filetype", default="by_suffix", choices=["by_suffix", "ascii", "bin"])
    g = commands.add_parser("generate", help="a synthetic series with planted motifs")
    g.add_argument("output")
    g.add_argument("n", type=int)
    g.add_argument("--length", type=int, default=0)
    g.add_argument("--embeddings", type=int, nargs="*", default=[])
    g.add_argument("--random", action="store_true", help="a random number of motifs with random multiplicities")
    g.add_argument("--kind", default="walk", choices=["walk", "noise"])
    g.add_argument("--seed", type=int, default=SEED)
    d = commands.add_parser("compare", help="two result files; the exit code is the number of differing neighbours, 255 at most")
    d.add_argument("left")
    d.add_argument("right")
    v = commands.add_parser("validate", help="all result files of a folder against each other; the exit code as for compare")
    v.add_argument("folder")
    v.add_argument("--need-baseline", action="store_true", help="every configuration must have a result of a baseline algorithm")
    x = commands.add_parser("next-count", help="the next process count of a scaling run")
    x.add_argument("current", type=int)
    x.add_argument("base", type=int)
    x.add_argument("--variant", default="square_exp", choices=["linear", "square", "exp", "square_exp"])
    return top


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "next-count":
        print(next_process_count(a.current, a.variant, a.base))
        return 0
    if a.command == "convert":
        print((files.convert_series if a.kind == "series" else files.convert_profile)(spark, a.source, a.target, fmt=a.filetype, target_fmt=a.target_filetype))
        return 0
    if a.command == "generate":
        embeddings = choose_embeddings(a.n, a.length, a.seed) if a.random else a.embeddings
        series, places = generate(spark, a.n, a.length, embeddings, a.kind, a.seed)
        files.write_series(series, a.output)
        for motif, start, scale in places:
            print(f"motif {motif} at {start}, scaled by {scale:.3f}")
        return 0
    if a.command == "compare":
        found = compare(files.read_profile(spark, a.left), files.read_profile(spark, a.right)).first().asDict()
        print(found)
        return min(255, found["n_diff"] + found["n_only_left"] + found["n_only_right"])
    if a.command == "validate":
        table, summary = files.validate_folder(spark, a.folder, a.need_baseline)
        for r in table.collect():  # one row for each result file
            print(r.asDict())
        print(summary)
        return min(255, summary["differences"])
    phases = Phases()
    fmt = files.format_of(a.input, a.filetype)
    with phases.phase("read"):
        series = files.read_series(spark, a.input, fmt, **({"chunk_rows": a.chunk_rows} if fmt == "bin" and a.chunk_rows else {}))
        n = checked_length(series, a.window)
    step = max(1, int(a.stride * a.window))
    with phases.phase("evaluate"):
        if a.strategy == "sampled":
            found = sampled_profile(series, a.window, step)
        elif a.strategy == "refined":
            found = refined_profile(series, a.window, step)
        else:
            found = matrix_profile(series, a.window, a.strategy, tile_size=a.tile)
        files.write_profile(found, a.output or files.output_name(a.strategy, a.window, a.input, fmt), chunk_rows=a.chunk_rows)
    print({k: round(v, 3) for k, v in phases.seconds.items()}, {k: round(v) for k, v in phases.throughput(n, a.window).items()})
    return 0


def main() -> int:
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("motifgrid").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
