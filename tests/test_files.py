"""Files, converters, generator and partitioning formulas."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifgrid.plans import partitioning, strategies
from motifgrid.sources import binary, files, generate


@pytest.fixture
def walk(spark):
    return spark.range(500).select(F.col("id").alias("pos"), (F.sin("id") * 100 + F.col("id") / 7).alias("value"))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("end", ["bin", "ascii"])
def test_series_round_trip(spark, walk, tmp_path, end):
    path = str(tmp_path / f"s.{end}")
    files.write_series(walk.repartition(7), path)
    assert rows(files.read_series(spark, path)) == rows(walk)
    assert files.series_length(spark, path) == 500


def test_binary_layout_and_slices(spark, walk, tmp_path):
    path = str(tmp_path / "s.bin")
    binary.write_binary(walk.repartition(5), path)
    raw = open(path, "rb").read()
    assert struct.unpack("<IIQ", raw[:16]) == (2, 100, 500) and len(raw) == 100 + 8 * 500
    assert np.frombuffer(raw[100:], "<f8").tolist() == [v for _, v in rows(walk)]
    part = binary.read_binary(spark, path, offset=100, length=50, partitions=3, chunk_rows=7)
    assert rows(part) == rows(walk)[100:150] and part.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="outside"):
        binary.read_binary(spark, path, offset=490, length=20).collect()


def test_binary_errors(spark, walk, tmp_path):
    path = str(tmp_path / "s.bin")
    with pytest.raises(Exception, match="each once"):
        binary.write_binary(walk.filter("pos <> 3"), path)
    binary.write_binary(walk, path)
    with pytest.raises(ValueError, match="version"):
        binary.read_header(path, "profile")
    with pytest.raises(Exception, match="exists"):
        binary.write_binary(walk, path)
    binary.write_binary(walk.limit(0), str(tmp_path / "empty.bin"))
    assert binary.read_binary(spark, str(tmp_path / "empty.bin")).count() == 0
    (tmp_path / "short.bin").write_bytes(struct.pack("<IIQ", 2, 100, 9).ljust(100, b"\0"))
    with pytest.raises(ValueError, match="too few"):
        binary.read_header(str(tmp_path / "short.bin"), "series")


def test_profile_files(spark, tmp_path):
    p = spark.createDataFrame([(0, 1.5, 2), (1, None, None), (2, 0.0, 0)], "pos bigint, dist double, nn bigint")
    for end in ("bin", "ascii"):
        path = str(tmp_path / f"p.{end}")
        files.write_profile(p, path)
        assert rows(files.read_profile(spark, path).fillna(-1)) == rows(p.fillna(-1))
    raw = open(str(tmp_path / "p.bin"), "rb").read()
    assert struct.unpack("<dq", raw[100:116]) == (2.25, 2) and struct.unpack("<q", raw[124:132]) == (-1,)
    files.convert_profile(spark, str(tmp_path / "p.ascii"), str(tmp_path / "q.bin"))
    assert open(str(tmp_path / "q.bin"), "rb").read() == raw


def test_conversions_and_formats(spark, walk, tmp_path):
    a, b, c = (str(tmp_path / n) for n in ("a.ascii", "b.bin", "c.ascii"))
    files.write_series(walk, a)
    files.convert_series(spark, a, b)
    files.convert_series(spark, b, c)
    assert rows(files.read_series(spark, c)) == rows(walk)
    (tmp_path / "line.ascii").write_text("1 2.5\t-3\n 4e2")
    assert [v for _, v in rows(files.read_series(spark, str(tmp_path / "line.ascii")))] == [1, 2.5, -3, 400]
    with pytest.raises(ValueError):
        files.format_of("series.txt")
    assert files.output_name("broadcast", 8, "/x/s.bin", "bin") == "broadcast_8_s.bin.matprof.bin"


def test_generator_plants_motifs_that_are_found(spark):
    series, places = generate.generate(spark, 3000, 60, [2], kind="noise")
    again, _ = generate.generate(spark, 3000, 60, [2], kind="noise")
    assert rows(series) == rows(again.repartition(3))
    (_, a, _), (_, b, _) = sorted(places, key=lambda p: p[1])
    found = strategies.matrix_profile(series, 60).orderBy("dist").first()
    assert abs(min(found["pos"], found["nn"]) - a) <= 2 and abs(max(found["pos"], found["nn"]) - b) <= 2
    with pytest.raises(ValueError):
        generate.choose_places(100, 60, [2])
    places = generate.choose_places(500, 20, [3, 4])
    starts = sorted(s for _, s, _ in places)
    assert all(y - x >= 20 for x, y in zip(starts, starts[1:])) and starts[-1] + 20 <= 500
    assert sum(generate.choose_embeddings(1000, 10)) <= 50


@pytest.mark.parametrize("parts,items", [(3, 10), (4, 4), (5, 3), (1, 0)])
def test_split_work(spark, parts, items):
    found = partitioning.split_work(spark, parts, items).orderBy("part").collect()
    sizes = [r["size"] for r in found]
    assert sum(sizes) == items and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    covered = [k for r in found for k in range(r["first"], r["last"] + 1)]
    assert covered == list(range(items))


def test_grid_formulas(spark):
    pairs = partitioning.balanced_pairs(spark, 3, 20).groupBy("rank").agg(F.sum("size").alias("n"), F.sum("part").alias("s")).collect()
    assert sum(r["n"] for r in pairs) == 20 and {r["s"] for r in pairs} == {5}
    tiles = partitioning.triangle_tiles(spark, 4)
    assert tiles.count() == 16 and tiles.filter("col > row").count() == 0
    assert tiles.filter("row = col").count() == 4
    assert [partitioning.next_process_count(4, k) for k in ("linear", "exp", "square", "square_exp")] == [6, 8, 9, 9]
    assert [partitioning.next_process_count(6, k, 3) for k in ("linear", "exp", "square", "square_exp")] == [9, 9, 9, 9]
    assert [partitioning.next_process_count(n, "square_exp") for n in (1, 9, 16, 25, 36)] == [4, 16, 36, 36, 81]
    assert partitioning.next_process_count(9, "exp", 3) == 27 and partitioning.next_process_count(4, "linear", 1) == 5
    for bad in ((0, "exp", 2), (4, "exp", 1), (4, "cube", 2)):
        with pytest.raises(ValueError):
            partitioning.next_process_count(*bad)
