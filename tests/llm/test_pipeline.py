from __future__ import annotations

import math
import re
from dataclasses import replace

import pytest
import regex

import corpus_pipeline as C
from motifgrid.llm import langid, piece_codec, queries
from tests.llm.conftest import rows
from tests.llm.test_langid import grams
from tests.llm.test_pii import brute as plain_base
from tests.llm.test_simhash_dedup import brute, plain_simhash

SF = "/root/testdata/sf0.001"


def plain_accepts(model, text):
    """Whether enough of the text's n-grams are common, in plain Python."""
    counts = grams(text or "")
    known = sum(n for f, n in counts.items() if model.idf[f] <= model.common)
    return bool(counts) and known / sum(counts.values()) >= model.familiar


def plain_shingles(text):
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_redacted(text):
    """Base kinds by their rules alone, the added kinds by rules of their own, overlaps to the first."""
    found = [(a, P_KINDS.index(k), b, k) for k, a, b in plain_base(text)]
    near = lambda a, b: set(re.findall(r"[^\W\d_][\w-]*", (text[max(0, a - 48) : a] + " " + text[b : b + 48]).lower()))
    for m in re.finditer(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])", text):
        if near(*m.span()) & {"token", "key", "secret", "password", "api", "bearer", "auth"}:
            found.append((m.start(), 6, m.end(), "secret"))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if near(*m.span()) & {"ssn", "social", "security", "taxpayer"}:
            found.append((m.start(), 5, m.end(), "ssn"))
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            found.append((m.start(), 4, m.end(), "iban"))
    out, at, end, name = "", 0, -1, None
    for a, _, b, kind in sorted(found):
        if a >= end:
            if name:
                out, at = out + f"[{name}]", end
            out, end, name = out + text[at:a], b, kind.upper()
        else:
            end = max(end, b)
    return out + (f"[{name}]" + text[end:] if name else text[at:])


P_KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]


def test_stages_against_brute_force(spark, real):
    """Each stage's decisions, made again by plain means on its own input."""
    docs = real.unionByName(spark.createDataFrame([(-1, "жзщ " * 40, "en", "x", 160), (-2, "12 !!", "en", "x", 5), (-3, None, "en", "x", None)], real.schema))
    model = langid.fit(langid.learnable(docs))
    out = C.language_id(spark, docs, SF)
    want = [tuple(r) for r in docs.collect() if plain_accepts(model, r["text"])]
    assert rows(out) == sorted(want, key=repr) and real.count() >= len(want) > 0.95 * real.count()
    assert not {-1, -2, -3} & {r["doc_id"] for r in out.collect()}

    docs, out = out, C.near_dedup(spark, out, SF)
    held = docs.collect()
    keep = {i for i, _, c in brute([(r["doc_id"], plain_simhash(r["text"])) for r in held]) if i == c}
    assert rows(out) == sorted([tuple(r) for r in held if r["doc_id"] in keep], key=repr)

    docs, out = out, C.benchmark_decontamination(spark, out, SF)
    items = [x for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (x := plain_shingles(r["text"]))]
    leaked = lambda text: any(len(x & own) >= 0.8 * len(x) - 1e-9 for own in [plain_shingles(text)] for x in items)
    assert rows(out) == sorted([tuple(r) for r in docs.collect() if not leaked(r["text"])], key=repr)

    docs, out = out, C.personal_data(spark, out, SF)
    want = [(r["doc_id"], t := plain_redacted(r["text"]), r["lang"], r["source"], len(t)) for r in docs.collect()]
    assert rows(out) == sorted(want, key=repr)

    docs, out = out, C.pieces(spark, out, SF)
    codec = piece_codec.codec(queries.PIECE_MODEL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = out.collect()
    assert {r["doc_id"]: codec.decode(r["pieces"]) for r in found} == texts and all(r["lossless"] for r in found)


#: Texts in languages that the tables don't have.
FOREIGN = [
    "La casa è grande e il giardino è pieno di fiori, ma la strada che porta alla città è lunga e stretta. Gli uomini della nave hanno visto una luce nella notte.",
    "Het huis is groot en de tuin staat vol bloemen, maar de weg die naar de stad leidt is lang en smal. De mannen van het schip hebben in de nacht een licht gezien.",
    "Talo on suuri ja puutarha on täynnä kukkia, mutta kaupunkiin johtava tie on pitkä ja kapea. Laivan miehet näkivät yöllä valon ja palasivat satamaan.",
    "A casa é grande e o jardim está cheio de flores, mas a estrada que leva à cidade é longa e estreita. Os homens do navio viram uma luz durante a noite.",
]


def plain_identified(model, text):
    """Whether n-grams raise the predicted language's odds three times, in plain Python."""

    def softmax(x):
        e = [math.exp((v - max(x)) / model.temperature) for v in x]
        return [v / sum(e) for v in e]

    value = {f: (1 + math.log(n)) * float(model.idf[f]) for f, n in grams(text).items()}
    length = math.sqrt(sum(v * v for v in value.values()))
    bias = [float(b) for b in model.bias]
    p = softmax([b + sum(v / length * float(model.weights[f][k]) for f, v in value.items()) for k, b in enumerate(bias)])
    k, before = p.index(max(p)), softmax(bias)
    return p[k] / (1 - p[k]) >= 3 * before[k] / (1 - before[k])


def plain_in_parts(model, text):
    line = " ".join(w for w in text.split() if not any(c.isdigit() for c in w))
    parts = [line[k : k + 64] for k in range(0, len(line), 64)]
    sizes = [(sum(grams(x).values()), x) for x in parts]
    return 2 * sum(n for n, x in sizes if n and plain_identified(model, x)) >= sum(n for n, _ in sizes) > 0


def test_the_language_stage_predicts_languages(spark, real):
    """Texts in languages never learned go, though their n-grams are common; texts in several learned ones stay."""
    some = {r["lang"]: r["text"][:300] for r in real.filter("length(text) > 300").collect()}
    assert len(some) == 4
    hashed = "Straße und Haus, token = " + "6cfd1f1f244d4c4c327ecfd8fd9898497c475388 " * 3
    odd = dict(enumerate([" ".join(some.values()), hashed, *FOREIGN], 1))
    docs = real.unionByName(spark.createDataFrame([(-k, t, None, "x", len(t)) for k, t in odd.items()], real.schema))
    model = langid.fit(langid.learnable(docs))
    assert all(plain_accepts(model, t) for t in FOREIGN)  # by common n-grams alone they would stay
    assert not plain_identified(model, odd[1]) and plain_in_parts(model, odd[1])
    kept = {r["doc_id"] for r in C.language_id(spark, docs, SF).collect()}
    assert -1 in kept and not kept & set(range(-len(odd), -2))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if grams(r["text"] or "")}
    assert kept == {i for i, t in texts.items() if plain_accepts(model, t) and (plain_identified(model, t) or plain_in_parts(model, t))}


def test_without_weights_no_language_is_identified(real):
    model = langid.fit(langid.learnable(real))
    assert langid.accepted(real, model).count() > 0.95 * real.count()
    assert langid.accepted(real, replace(model, weights=0 * model.weights)).isEmpty()


def test_a_run_leaves_only_its_result(spark):
    from motifgrid import storage

    before = len(storage._written)
    out = C.run(spark, SF)
    assert len(storage._written) == before + 1 and out.count() > 0


def test_columns_stay_until_the_last_stage(spark, clashing, nothing):
    for df in (clashing, nothing):
        for _, stage in C.STAGES[:-1]:
            df = stage(spark, df, SF)
        assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        last = C.STAGES[-1][1](spark, df, SF)
        assert last.count() == df.count()


def test_run(spark, real):
    found = C.run(spark, SF)
    assert 0.5 * real.count() < found.count() < real.count() and found.filter("NOT lossless").isEmpty()
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "sentencepiece"]
    assert C.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
