from __future__ import annotations

import zlib

import numpy as np
import pytest

from motifgrid.llm import quality_cnn as Q
from motifgrid.llm import queries
from tests.llm.conftest import LONG, ROWS


def brute_features(net, text):
    """Filters, rectifier and pooling place by place."""
    raw = text.encode()
    n = max(1, -(-len(raw) // Q.STRIDE)) * Q.STRIDE
    b = list(raw.ljust(n + Q.WIDTH - 1, b"\0"))
    answers = np.array([sum(net.filters[o][b[p + o]] for o in range(Q.WIDTH)) for p in range(n)])
    chunks = [answers[a : a + Q.CHUNK].max(axis=0) for a in range(0, max(1, n - Q.STRIDE), Q.STRIDE)]
    pooled = np.maximum(np.array(chunks) + net.bias, 0)
    return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])


@pytest.mark.parametrize("length", [0, 1, 255, 256, 257, 700])
def test_features_cover_every_byte(length):
    net = Q.fresh()
    text = (LONG[:350] + "é" * 400)[:length]
    assert np.allclose(net.features(text.encode()), brute_features(net, text), atol=1e-4)


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    net = Q.fresh()
    whole = net.features(LONG.encode())
    monkeypatch.setattr(Q, "PIECE", 2 * Q.STRIDE)
    assert np.array_equal(whole, net.features(LONG.encode()))


def test_gradients_learn_a_simple_rule():
    texts = ["good words here " * k + ("%%%" if k % 2 else "") for k in range(1, 60)]
    labels = [0 if k % 2 else 1 for k in range(1, 60)]
    net = Q.train(texts, labels, epochs=20)
    assert np.mean([(net.score(t) > 0.5) == y for t, y in zip(texts, labels)]) == 1


def test_held_out_ranking(spark, duck):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in queries.op4_quality(spark, sf).collect()}
    labels = duck.execute(f"SELECT doc_id, quality FROM read_parquet('{sf}/labels.parquet')").fetchall()
    assert len(found) == duck.execute(f"SELECT count(*) FROM read_parquet('{sf}/documents.parquet')").fetchone()[0]
    held = [(found[i]["score"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found.values())


def test_edge_rows(spark, docs, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, None), (6, 0, 1), (None, 1, 0), (7, None, 0), (8, 5, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    for df in (docs, clashing):
        net = Q.fit(df, labels)
        found = Q.score(df, net)
        assert found.columns == ["doc_id", "score"] and found.count() == len(ROWS)
        by = {r["doc_id"]: r["score"] for r in found.collect()}
        assert by[3] == by[4] and all(0 <= s <= 1 for s in by.values())
    assert Q.score(docs, Q.fit(docs, labels.limit(0))).select("score").distinct().collect()[0][0] == 0.5
    assert Q.fit(docs, labels.filter("quality = 1")).score("anything") > 0.99
    assert Q.score(nothing, Q.fit(nothing, labels)).count() == 0


def brute_score(net, text):
    """Features place by place and the logistic output, with plain sums."""
    f = brute_features(net, text)
    return 1 / (1 + np.exp(-(sum(float(a) * float(b) for a, b in zip(f, net.out)) + net.out_bias)))


def test_query_against_brute_force(spark, real):
    """The registered query's score and label of every document, made again from the learned weights byte by byte."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    net = Q.fit(real, labels, learn=Q_learn())
    found = {r["doc_id"]: r for r in queries.op4_quality(spark, "/root/testdata/sf0.001").collect()}
    for r in sorted(real.collect(), key=lambda r: len(r["text"] or ""))[:60]:
        want = brute_score(net, r["text"] or "")
        assert abs(found[r["doc_id"]]["score"] - want) < 1e-4
        assert found[r["doc_id"]]["predicted"] == int(found[r["doc_id"]]["score"] >= 0.7)


def Q_learn():
    from motifgrid.llm.common import id_remainder

    return id_remainder("doc_id") != 2


def test_held_out_labels_steer_nothing(spark, real):
    """Turning every label that may not be learned from changes no weight."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q_learn(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (Q.fit(real, x, learn=Q_learn()) for x in (labels, turned))
    assert np.array_equal(a.filters, b.filters) and np.array_equal(a.out, b.out) and a.out_bias == b.out_bias


def test_repeated_labels_and_rows_stay_bounded(spark):
    docs = spark.range(3000).selectExpr("1L AS doc_id", "concat('text ', id % 50) AS text").unionByName(spark.range(2, 60).selectExpr("id AS doc_id", "concat('%%', id) AS text"))
    labels = spark.range(5000).selectExpr("1L AS doc_id", "1 AS quality").unionByName(spark.range(2, 60).selectExpr("id AS doc_id", "0 AS quality"))
    net = Q.fit(docs, labels, per_class=100)
    assert net.score("text 7") > net.score("%%7")
