from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifgrid.llm import langid as L
from motifgrid.llm import queries
from tests.llm.conftest import LONG, ROWS, rows


@pytest.fixture(scope="module")
def model(real):
    return L.fit(L.learnable(real))


def test_held_out_accuracy(spark, real):
    found = {r["doc_id"]: r for r in queries.op1_language_id(spark, "/root/testdata/sf0.001").collect()}
    truth = {r["doc_id"]: r["lang"] for r in real.collect()}
    assert found.keys() == truth.keys()
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(found[k]["held_out"] == (k in set(held)) for k in truth)
    assert np.mean([found[k]["lang_pred"] == truth[k] for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_edge_rows(docs, clashing, model):
    for df in (docs, clashing):
        found = L.identify(df, model)
        assert found.columns == ["doc_id", "lang_pred", "score"] and found.count() == len(ROWS)
        by = {r["doc_id"]: r for r in found.collect()}
        assert [(by[k]["lang_pred"], by[k]["score"]) for k in (3, 4, 5, 8)] == [(L.UNKNOWN, 0.0)] * 4
        assert by[6]["lang_pred"] != L.UNKNOWN
    kept = L.accepted(clashing, model)
    assert kept.columns == clashing.columns and not {3, 4, 5, 8} & {r["doc_id"] for r in kept.collect()}


def test_nothing_to_learn_from(docs, nothing, model):
    empty = L.fit(nothing)
    assert {(r["lang_pred"], r["score"]) for r in L.identify(docs, empty).collect()} == {(L.UNKNOWN, 0.0)}
    assert L.identify(nothing, model).count() == 0 and L.accepted(nothing, model).count() == 0
    one = L.fit(docs.filter("doc_id = 1"))
    assert one.langs == ["en"] and one.predict("words")[0] == "en"


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = "Ä" + LONG[:5000] + "\n12 fin."
    whole = L.ngram_counts(text)
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(L, "PIECE", size)
        part = L.ngram_counts(text)
        assert whole[0].tolist() == part[0].tolist() and whole[1].tolist() == part[1].tolist()


def test_weights_are_sparse_and_scores_calibrated(model):
    assert (model.weights == 0).mean() > 0.3
    logits = np.array([[4.0, 0.0], [4.0, 0.0], [0.0, 4.0], [4.0, 0.0]])
    assert L.calibrate(logits, np.array([0, 0, 1, 1])) > 1  # too sure of itself: cooled down


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e5])
def test_the_temperature_is_the_least_loss_inside_its_bracket(scale):
    """Also where every row is right: the mean score is then what so many rows can show, at any scale of the logits."""
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 400)
    logits = scale * (np.eye(3)[y] * 5 + r.normal(0, 0.1, (400, 3)))
    t = L.calibrate(logits, y)
    top = np.array([L.softmax(x / t).max() for x in logits])
    assert abs(top.mean() - 401 / 402) < 2e-3 and top.max() < 1

    def loss(t):
        p = np.array([L.softmax(x / t) for x in logits])
        target = np.full((400, 3), 1 / 402 / 2)
        target[np.arange(400), y] = 401 / 402
        return -(target * np.log(p)).sum()

    assert loss(t) < min(loss(t * 1.05), loss(t / 1.05))


def grams(text):
    """Bins and counts of a text's n-grams in plain Python; none without a letter."""
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    line = [32]
    for c in letters:
        if c != " " or line[-1] != 32:
            line.append(ord(c))
    m, counts = (1 << 32) - 1, {}
    if all(c == 32 for c in line):
        return counts
    for k in range(1, len(line)):
        a, b, c = line[k - 2] if k > 1 else None, line[k - 1], line[k]
        found = [(c * 2654435761 & m) >> 17, (((b * 2246822519 & m) ^ (c * 3266489917 & m)) * 668265263 & m) >> 17]
        if a is not None:
            found.append((((a * 374761393 & m) ^ (b * 2246822519 & m) ^ (c * 2654435761 & m)) * 3266489917 & m) >> 17)
        for f in found:
            counts[f] = counts.get(f, 0) + 1
    return counts


def brute_predict(model, text):
    """N-grams, weights of terms and softmax in plain Python."""
    counts = grams(text)
    if not counts:
        return L.UNKNOWN, 0.0
    value = {f: (1 + math.log(n)) * float(model.idf[f]) for f, n in counts.items()}
    length = math.sqrt(sum(v * v for v in value.values()))
    x = [(sum(v / length * float(model.weights[f][k]) for f, v in value.items()) + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
    e = [math.exp(v - max(x)) for v in x]
    k = max(range(len(x)), key=lambda j: x[j])
    return model.langs[k], e[k] / sum(e)


def test_query_against_plain_python(spark, real, model):
    """Every text's language and score, from the model's weights, made again without numpy or hashing in one go."""
    query = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op1_language_id(spark, "/root/testdata/sf0.001").collect()}
    same = L.fit(L.learnable(real), key=F.col("doc_id"))
    for r in real.collect():
        lang, score = brute_predict(same, r["text"] or "")
        assert query[r["doc_id"]][0] == lang and abs(query[r["doc_id"]][1] - score) < 1e-3
    for text in ("Ça va? ÄÖÜ ß ǅ İ", "a", " 12 a-b ", "x" * 3000):
        lang, score = brute_predict(model, text)
        assert model.predict(text)[0] == lang and abs(model.predict(text)[1] - score) < 1e-3


def test_copies_and_many_languages_are_learned(spark):
    """A language of one text repeated without end, in rows of other or the same ids, and more languages than any cap."""
    hot = spark.range(12_000).select(F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "the house and the garden").otherwise("a street of the town").alias("text"), F.lit(1).alias("doc_id"))
    other = spark.createDataFrame([("fr", f"la maison numero {'abcdefghij'[k % 10]} et le jardin {'klmnopqrst'[k // 10]}", k) for k in range(60)], "lang string, text string, doc_id int")
    found = L.fit(hot.withColumn("doc_id", F.pmod(F.monotonically_increasing_id(), F.lit(1_000_003)).cast("int")).unionByName(other))
    assert found.predict("the garden of the house")[0] == "en" and found.predict("le jardin et la maison")[0] == "fr"
    same = L.fit(hot.unionByName(other.limit(2)))  # two different rows of each language, however often they occur
    assert same.predict("the house and the garden")[0] == "en" or same.predict("a street of the town")[0] == "en"
    many = spark.range(300).select(F.concat(F.lit("l"), F.col("id")).alias("lang"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij").alias("text"))
    assert len(L.fit(many).langs) == 300


def test_long_rows_are_learned_from(spark):
    long = spark.createDataFrame([("la", LONG + str(k)) for k in range(3)] + [("en", f"the words of row {k}") for k in range(40)], "lang string, text string")
    assert L.fit(long).predict("lorem ipsum dolor sit amet")[0] == "la"


def test_planted_junk_is_rejected_and_nothing_else(spark, real, model):
    draw = random.Random(5)
    junk = ["".join(draw.choice("бвгджзклмнпрст") for _ in range(200)), "漢字仮名交じり文" * 30, "qxzjkvwq " * 0 + " ".join("".join(draw.choice("qxzjkvwpfg") for _ in range(9)) for _ in range(40)), "123 !!", "", None]
    mixed = " ".join(r["text"][:300] for r in real.filter("lang IN ('en', 'de', 'fr', 'es') AND length(text) > 300").limit(4).collect())
    df = real.select("doc_id", "text").unionByName(spark.createDataFrame([(-k, t) for k, t in enumerate([mixed, *junk], 1)], "doc_id bigint, text string"))
    kept = {r["doc_id"] for r in L.accepted(df, model).collect()}
    assert -1 in kept and not kept & set(range(-len(junk) - 1, -1))
    assert real.filter("text RLIKE '[A-Za-z]{20}|[a-z]+ [a-z]+ [a-z]+'").select("doc_id").distinct().count() <= len(kept) - 1


def test_only_learnable_rows_count(spark, real):
    """Other rows' labels change nothing."""
    held = real.filter(L.id_remainder("doc_id") == 2).withColumn("lang", real["source"])
    a = L.fit(L.learnable(real.filter(L.id_remainder("doc_id") != 2).unionByName(held)))
    b = L.fit(L.learnable(real))
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature
    assert rows(L.learnable(held)) == []
