from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motifgrid.llm import decontamination as D
from motifgrid.llm import license_scan as N
from motifgrid.llm import queries
from tests.llm.conftest import LONG, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, against_duck):
    against_duck(queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op2_license_scan", "op6_decontamination", "op9_sharding"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_license_edge_rows(spark, docs, clashing, nothing):
    known = N.known_digests(spark)
    for df in (docs, clashing):
        found = [(r["doc_id"], r["unit"], r["line"], r["license"]) for r in N.scan(df, known).collect()]
        assert found == [(9, "line", 1, "MIT")]
    assert N.scan(nothing, known).count() == 0
    assert N.scan(docs, known.limit(0)).count() == 0


def test_license_canonical_forms(spark):
    text = next(t for k, t in N.TEXTS if k == "MIT")
    changed = "Copyright (c) 2020 Somebody\n\n" + text.upper().replace("SUBLICENSE", "sub-license").replace("COPYRIGHT HOLDERS", "Copyright Owners").replace(",", " ;").replace("\n", "\n\n  ")
    df = spark.createDataFrame([(1, changed), (2, changed + " and more"), (3, "LICENCED under the Apache Licence, version 2.0"), (4, None), (3, "LICENCED under the Apache Licence, version 2.0")], "doc_id bigint, text string")
    found = sorted((r["doc_id"], r["unit"], r["license"]) for r in N.scan(df, N.known_digests(spark)).collect())
    assert found == [(1, "document", "MIT"), (3, "document", "Apache-2.0"), (3, "document", "Apache-2.0")]


def test_every_known_text_matches_itself(spark):
    known = N.known_digests(spark)
    texts = N.notices(spark).unionByName(spark.createDataFrame(N.TEXTS, "license string, text string"))
    df = texts.withColumn("doc_id", F.xxhash64("license", "text"))
    found = {(r["doc_id"], r["license"]) for r in N.scan(df, known).collect()}
    assert {(r["doc_id"], r["license"]) for r in df.collect()} <= found
    assert known.groupBy("digest").agg(F.countDistinct("license").alias("n")).filter("n > 1").isEmpty()


def test_no_spelling_rule_loses_a_match(spark):
    """However much a rule shortens or lengthens a text, the text still matches itself in any spelling."""
    pairs = [("GPL version 3", "gpl V3"), ("version 3", "v3"), ("per cent " * 9, "percent " * 9), ("LICENSOR licensee", "licencor licencee"), ("sub license", "sub-licence"), ("copyright owners", "the Copyright holder".replace("the ", "")), ("acknowledgement organise authorise favour non infringement merchantibility", "acknowledgment organize authorize favor noninfringement merchantability")]
    known = N.digests_of(spark.createDataFrame([(str(k), a) for k, (a, _) in enumerate(pairs)], "license string, text string"))
    docs = spark.createDataFrame([(k, x) for k, pair in enumerate(pairs) for x in pair], "doc_id int, text string")
    found = sorted((r["doc_id"], r["license"]) for r in N.scan(docs, known).collect())
    assert found == sorted((k, str(k)) for k, (a, b) in enumerate(pairs) for x in (a, b) if not x.lower().startswith("copyright"))


def test_long_texts_have_the_listed_digests(spark):
    """Where the machine has the public texts, their canonical digests are the listed ones."""
    from pathlib import Path

    home = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((home / n).exists() for n in names):
        pytest.skip("no licence texts here")
    found = N.digests_of(spark.createDataFrame([(k, (home / n).read_text()) for n, k in names.items()], "license string, text string"))
    assert {(r["license"], r["chars"], r["digest"]) for r in found.collect()} <= set(N.DIGESTS)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def test_leaks(spark, docs, nothing):
    w = ITEM.split()
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words"), (5, ITEM), (None, "one two three four five six seven")], "item_id bigint, text string")
    texts = [
        (1, LONG + " " + ITEM.upper().replace(" ", ", ") + "! " + LONG),
        (2, " ".join(w[:13]) + " other words follow here"),  # 9 of 11 shingles: 0.82
        (3, " ".join(w[:12]) + " other words follow here"),  # 8 of 11
        (4, "Two   WORDS"),
        (5, "two words more"),
        (6, None),
        (7, ""),
        (None, "zero " + ITEM),
        (1, "nothing of it"),
        (8, "so one two three four five six seven eight"),
    ]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("w", "h", "item_id", "candidate", "size", "least")})
    found = D.leaks(df, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 1), (1, 5), (2, 1), (2, 5), (4, 4), (None, 1), (None, 5), (8, None)}
    kept = D.clean(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7]
    assert rows(D.clean(docs, items.limit(0))) == rows(docs)
    assert D.leaks(nothing, items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_leaks_without_broadcast(spark, real, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    a = rows(D.leaks(real, items))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert rows(D.leaks(real, items)) == a and a


def test_many_candidates_of_one_document(spark, monkeypatch):
    """Candidates of a document are checked in groups of any size with one result."""
    words = [f"w{k}" for k in range(400)]
    items = spark.createDataFrame([(k, " ".join(words[k : k + 20])) for k in range(300)] + [(1, " ".join(words[1:21])), (999, "not in there at all my friend")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:30])), (3, "nothing")], "doc_id bigint, text string")
    whole = rows(D.leaks(df, items))
    assert {r[1] for r in whole if r[0] == 1} == set(range(300)) and {r[1] for r in whole if r[0] == 2} == set(range(14))
    monkeypatch.setattr(D, "TOGETHER", 7)
    assert rows(D.leaks(df, items)) == whole


def test_sketch_never_misses(spark):
    """Every way to lose a fifth of the shingles keeps one of the sketch."""
    table = D.item_table(spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"), 5, 0.8)
    r = table.first()
    sketch = D.sketches(table, 5).count()
    assert sketch == r["n"] - r["need"] + 1 and r["need"] / r["n"] >= 0.8 > (r["need"] - 1) / r["n"]
