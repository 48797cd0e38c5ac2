"""Streaming, the table function, the command line and timing."""

from __future__ import annotations

import numpy as np
import pytest

from motifgrid.__main__ import run
from motifgrid.functions import udtf
from motifgrid.functions.timing import Phases
from motifgrid.plans import strategies
from motifgrid.sources import files
from motifgrid.streaming.append import ProfileStream
from tests.test_engine import got, make, same


def test_streamed_profile_equals_the_whole_one(spark, tmp_path):
    values = np.random.default_rng(0).integers(0, 80, 120).tolist()
    source = tmp_path / "in"
    stream = ProfileStream(spark, str(tmp_path / "state"), 8, tile_size=16)
    s = make(spark, values)
    done = 0
    for k, end in enumerate((5, 60, 61, 120)):
        s.filter(f"pos >= {done} AND pos < {end}").coalesce(1).write.mode("append").parquet(str(source))
        done = end
        query = spark.readStream.schema("pos bigint, c bigint").parquet(str(source)).writeStream.foreachBatch(stream.update).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        if end >= 8:
            same(got(stream.profile()), got(strategies.matrix_profile(s.filter(f"pos < {end}"), 8)))


def test_table_function(spark):
    udtf.register(spark, "profile_of")
    values = np.random.default_rng(1).integers(0, 50, 60).tolist()
    make(spark, values).selectExpr("pos", "c AS value", "pos % 1 AS k").createOrReplaceTempView("udtf_series")
    found = spark.sql("SELECT * FROM profile_of(TABLE(SELECT pos, value FROM udtf_series) WITH SINGLE PARTITION ORDER BY (pos), 6)")
    same({r["pos"]: (r["dist"], r["nn"]) for r in found.collect()}, got(strategies.matrix_profile(make(spark, values), 6)), 1e-12)


def test_command_line(spark, tmp_path, capsys):
    a, b, p, q = (str(tmp_path / n) for n in ("a.ascii", "a.bin", "p.bin", "q.ascii"))
    assert run(spark, ["generate", a, "400", "--length", "30", "--embeddings", "2"]) == 0
    assert run(spark, ["convert", "series", a, b]) == 0
    assert run(spark, ["profile", "--strategy", "broadcast", "--window", "30", "--input", b, "--output", p]) == 0
    assert run(spark, ["convert", "profile", p, q]) == 0
    assert run(spark, ["compare", p, q]) == 0
    r = str(tmp_path / "r.ascii")
    assert run(spark, ["profile", "--strategy", "sampled", "--stride", "0.5", "--window", "30", "--input", a, "--output", r]) == 0
    assert files.read_profile(spark, r).count() == 371
    assert run(spark, ["profile", "--strategy", "sql", "--window", "30", "--input", b, "--output", str(tmp_path / "w.bin")]) == 0
    assert run(spark, ["compare", p, str(tmp_path / "w.bin")]) == 0  # doubles, on every strategy
    other = files.read_profile(spark, p).selectExpr("pos", "dist", "CASE WHEN pos < 3 THEN nn + 1 ELSE nn END AS nn")
    files.write_profile(other, str(tmp_path / "x.bin"), chunk_rows=7)
    assert run(spark, ["compare", p, str(tmp_path / "x.bin")]) == 3
    assert run(spark, ["convert", "series", str(tmp_path / "a.bin"), str(tmp_path / "named"), "--target-filetype", "ascii"]) == 0
    assert run(spark, ["convert", "series", str(tmp_path / "named"), "--filetype", "ascii"]) == 0
    assert files.read_series(spark, str(tmp_path / "named.bin")).count() == 400
    assert run(spark, ["generate", str(tmp_path / "g.bin"), "400", "--length", "20", "--random"]) == 0
    capsys.readouterr()
    assert run(spark, ["next-count", "6", "3", "--variant", "exp"]) == 0 and capsys.readouterr().out == "9\n"
    assert run(spark, ["profile", "--strategy", "broadcast", "--window", "30", "--input", b, "--output", str(tmp_path / "y.bin")]) == 0
    assert "entries_per_s" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run(spark, ["profile", "--strategy", "none", "--window", "3", "--input", a])


def test_folder_of_results(spark, tmp_path, capsys):
    folder = tmp_path / "results"
    p = spark.createDataFrame([(k, k / 2.0, k + 9) for k in range(12)], "pos bigint, dist double, nn bigint")
    off = p.selectExpr("pos", "dist + 0.25 AS dist", "CASE WHEN pos = 5 THEN 0 ELSE nn END AS nn")
    for name, df in {"matprof_v1_l20m9alg#sequential#_p1_x.bin": p, "matprof_v1_l20m9alg#tiles#_p4_x.ascii": p, "matprof_v1_l20m9alg#tiles#_p8_x.bin": off, "matprof_v2_l30m9alg#tiles#_p4_x.bin": p, "matprof_v2_l30m9alg#tiles#_p8_x.bin": p}.items():
        files.write_profile(df, str(folder / name))
    table, summary = files.validate_folder(spark, str(folder))
    assert table.count() == summary["pairs"] == 3 and summary["differences"] == 1 and abs(summary["max_abs_diff"] - 0.25) < 1e-6
    assert (summary["files"], summary["configs"], summary["algorithms"], summary["process_counts"], summary["lengths"], summary["windows"]) == (5, 2, ["sequential", "tiles"], ["1", "4", "8"], ["20", "30"], ["9"])
    assert run(spark, ["validate", str(folder)]) == 1
    with pytest.raises(ValueError, match="baseline"):
        files.validate_folder(spark, str(folder), need_baseline=True)
    files.write_profile(p, str(folder / "matprof_v3_l30m9alg#tiles#_p8_x.bin"))
    with pytest.raises(ValueError, match="nothing to compare"):
        files.validate_folder(spark, str(folder))


def test_a_stream_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    values = np.random.default_rng(2).integers(0, 80, 90).tolist()
    s, state = make(spark, values), str(tmp_path / "state")
    for k, (a, b) in enumerate([(0, 30), (30, 55), (55, 90)]):
        if k == 2:  # by blocks
            monkeypatch.setattr(strategies, "BROADCAST_VALUES", 10)
        ProfileStream(spark, state, 8, tile_size=16).update(s.filter(f"pos >= {a} AND pos < {b}"), k)
    monkeypatch.undo()
    stream = ProfileStream(spark, state, 8, tile_size=16)
    stream.update(s.filter("pos >= 55"), 2)  # the last batch again
    same(got(stream.profile()), got(strategies.matrix_profile(s, 8)))
    assert len(stream._versions()) == 2
    with pytest.raises(ValueError, match="each once"):
        stream.update(s.filter("pos >= 85"), 9)


def test_counters(spark):
    s = make(spark, np.random.default_rng(1).integers(0, 50, 200).tolist())
    df, seen = strategies.counted_profile(s, 10, tile_size=32)
    same(got(df), got(strategies.matrix_profile(s, 10)))
    p, band = 191, 2
    assert seen.get["cells"] == (p - band - 1) * (p - band) // 2 and seen.get["updates"] >= p and seen.get["partial_rows"] >= p


def test_tables_written_in_a_scope_go(spark):
    from motifgrid import storage

    before = len(storage._written)
    with storage.passing() as kept:
        a, b = storage.materialize(spark.range(3).toDF("id"), "one"), storage.materialize(spark.range(4).toDF("id"), "two")
        kept.append(b)
    assert len(storage._written) == before + 1 and b.count() == 4
    assert storage.names_in(spark, a._motifgrid_path) == []
    storage.discard(b)
    assert len(storage._written) == before


def test_phases():
    phases = Phases()
    with phases.phase("evaluate"):
        pass
    assert phases.throughput(100, 10)["entries_per_s"] > 0


def test_workers_import_the_package_from_anywhere(tmp_path):
    """A driver that only has the package on its own path still runs Python stages."""
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "elsewhere.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})\n"
        "from pyspark.sql import SparkSession, functions as F\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from motifgrid.plans.strategies import matrix_profile\n"
        "s = spark.range(60).select(F.col('id').alias('pos'), (F.col('id') * 7 % 13).alias('c'))\n"
        "assert matrix_profile(s, 6).count() == 55\n"
    )
    subprocess.run([sys.executable, str(script)], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", **{k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}})
