from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motifgrid.llm import queries
from motifgrid.llm import sharding as S
from tests.llm.conftest import ROWS, rows


def brute(key, weights):
    best = None
    for s, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        if best is None or -w / math.log(u) > best[0]:
            best = (-w / math.log(u), s)
    return best[1]


def key_of(i):
    return "" if i is None else str(i)


@pytest.mark.parametrize("bucket_rows", [S.BUCKET_ROWS, 1])
def test_edge_rows(docs, clashing, nothing, bucket_rows):
    for df in (docs, clashing):
        found = S.placed(df, weights=(1.0, 2.0, 0.5), bucket_rows=bucket_rows)
        assert found.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
        got = found.collect()
        raw = lambda t: (t or "").encode()
        want = Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t)), brute(key_of(i), (1, 2, 0.5)), brute(key_of(i), (1, 2, 0.5, 1))) for i, t, *_ in ROWS)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
        for s in range(3):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert S.placed(nothing).count() == 0


def test_query(spark, real):
    found = queries.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == 1000 and len({r["doc_id"] for r in found}) == 1000
    assert all(r["shard"] == brute(r["doc_id"], [1] * 16) and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" for r in found)
    assert 20 < sum(r["grown_shard"] == 16 for r in found) < 110
    for s in range(16):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_weights_and_growth(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("old").alias("shard"))
    shares = Counter(r["shard"] for r in S.assign(keys, "doc_id", (1, 1, 2)).collect())
    assert abs(shares[2] - 10_000) < 400 and abs(shares[0] - 5_000) < 400
    a, b = ({r["doc_id"]: r["shard"] for r in S.assign(keys, "doc_id", w).collect()} for w in ((1, 1, 2), (1, 1, 2, 1)))
    assert all(b[k] in (a[k], 3) for k in a)
    with pytest.raises(ValueError):
        S.rendezvous(F.lit("x"), (1, 0))


def test_a_row_repeated_without_end(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 16)
    many = spark.range(1000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.createDataFrame([(8, "other")], "doc_id bigint, text string"))
    found = S.placed(many, weights=(1.0,))
    assert sorted(r["slot"] for r in found.collect()) == list(range(1001))
    assert rows(found.groupBy("doc_id").count()) == [(7, 1000), (8, 1)]


def test_one_id_with_many_texts_is_spread(spark):
    """The null id and one other own all rows; no numbering bucket may hold most of them."""
    many = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(5).cast("bigint")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    found = S.placed(many, weights=(1.0,), bucket_rows=100)
    assert sorted(r["slot"] for r in found.collect()) == list(range(4000))
    order = found.orderBy("slot").select(F.col("doc_id").isNull().alias("n")).collect()
    assert sum(a["n"] != b["n"] for a, b in zip(order, order[1:])) > 50  # both ids lie in each of some 40 buckets
