from __future__ import annotations

import random
import re

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from motifgrid.llm import piece_codec as P
from motifgrid.llm import queries
from tests.llm.conftest import LONG, ROWS, rows

MODEL = queries.PIECE_MODEL


@pytest.fixture(scope="module")
def codec():
    return P.codec(MODEL)


def brute(codec, chunk, key, dropout):
    """The agenda by looking at every pair again and again; a pair draws once, when it first stands there."""
    sym, drawn = [(i, a) for i, a in enumerate(codec.symbols(chunk))], {}

    def meet(at):
        if 0 <= at < len(sym) - 1 and (k := codec.merge.get(sym[at][1] * codec.size + sym[at + 1][1])) is not None:
            n = len(drawn)
            h = P._mix((key + (n // 4 + 1) * P._C[0]) & P._M)
            drawn[sym[at], sym[at + 1]] = None if (h >> 16 * (n % 4)) % 65536 < round(dropout * 65536) else k

    for at in range(len(sym) - 1):
        meet(at)
    while True:
        best = min(((codec.rank[k], at, k) for at in range(len(sym) - 1) if (k := drawn.get((sym[at], sym[at + 1]))) is not None), default=None)
        if best is None:
            return [s for _, s in sym]
        sym[best[1] : best[1] + 2] = [(sym[best[1]][0], best[2])]
        meet(best[1])
        meet(best[1] - 1)


def test_without_dropout_the_pieces_are_the_library_s(codec, real):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r["text"] for r in real.select("text").collect() if "▁" not in r["text"]] + ["  two  blanks ", "日本語\x00\n\té 😀", LONG[:300].replace(" ", "")]
    for text, found in zip(texts, P.Encoder(codec, 0.0).encode(texts)):
        assert library.encode(text) == found.tolist()


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_batch_heap_and_brute_force_agree(codec, dropout):
    draw = random.Random(3)
    chunks = ["".join(draw.choice("the niaos▁é龘\n") for _ in range(draw.randint(1, 14))) for _ in range(300)]
    keys = [draw.getrandbits(64) for _ in chunks]
    want = [brute(codec, c, k, dropout) for c, k in zip(chunks, keys)]
    assert [codec.heap(codec.symbols(c), k, dropout) for c, k in zip(chunks, keys)] == want
    sym, lengths = codec.flat_symbols(chunks)
    pieces, counts, _ = codec.batch(sym, lengths, np.array(keys, np.uint64), dropout)
    assert [x.tolist() for x in np.split(pieces, np.cumsum(counts)[:-1])] == want


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_lossless(text):
    encoder = P.Encoder(P.codec(MODEL), 0.3)
    assert encoder.codec.decode(encoder.encode([text])[0].tolist()) == text


def test_dropout_varies_and_repeats(codec):
    text = "the internationalisation of transportation " * 50
    a, b = P.Encoder(codec).encode([text])[0], P.Encoder(codec).encode(["other", text, text])
    assert a.tolist() == b[1].tolist() == b[2].tolist()
    assert len(a) > len(P.Encoder(codec, 0.0).encode([text])[0])
    assert a.tolist() != P.Encoder(codec, seed=1).encode([text])[0].tolist()
    words = codec.decode(a.tolist()).split()
    assert words == text.split()
    cuts = {tuple(P.Encoder(codec).encode(["internationalisation " * k])[0].tolist()[-9:]) for k in range(1, 9)}
    assert len(cuts) > 1


def test_forgetting_changes_nothing(codec, monkeypatch):
    texts = [f"word{k} word{k + 1} the same the same" for k in range(60)]
    want = [x.tolist() for x in P.Encoder(codec).encode(texts)]
    monkeypatch.setattr(P, "REMEMBERED", 2000)
    small = P.Encoder(codec)
    assert [small.encode([t])[0].tolist() for t in texts] == want
    assert [x.tolist() for x in small.encode(texts)] == want


def test_every_occurrence_draws_for_itself(codec):
    """Whole texts against the agenda of each chunk by itself; a word has far more segmentations than any small number."""
    draw = random.Random(4)
    words = ["internationalisation", "the", "of", "a", "understanding", "x" * 60, "é龘▁", "straightforwardness" * 2]
    texts = [" ".join(draw.choice(words) for _ in range(400)) + "  " for _ in range(12)]
    encoder = P.Encoder(codec, 0.2)
    for _ in range(2):  # also with everything remembered
        for text, found in zip(texts, encoder.encode(texts)):
            base, want = xxhash.xxh64_intdigest(text.encode(), P.SEED), []
            for k, chunk in enumerate(re.findall(r" +[^ ]*|[^ ]+", " " + text), 1):
                want += brute(codec, chunk, P._mix((base + k * P._C[2]) & P._M), 0.2)
            assert found.tolist() == want
    cuts = set()
    for k in range(300):
        ids = encoder.encode([f"{k} internationalisation"])[0].tolist()
        cuts.add(tuple(codec.out[i] for i in ids)[-5:])
    assert len(cuts) > 60


def test_long_texts_in_parts(codec, monkeypatch):
    texts = ["  the  quick brown   fox " * 30, "word " * 50, "a" * 500 + "  b", " " * 300 + "x"]
    want = [x.tolist() for x in P.Encoder(codec).encode(texts)]
    for size, many in ((1, 1), (7, 5), (100, 1000)):
        monkeypatch.setattr(P, "PIECE", size)
        monkeypatch.setattr(P, "AT_ONCE", many)
        assert [x.tolist() for x in P.Encoder(codec).encode(texts)] == want


def test_a_first_text_of_one_long_chunk(codec):
    for text in ("a" * 500, "é" * 49, "x"):
        assert codec.decode(P.Encoder(codec).encode([text])[0].tolist()) == text
    assert P.Encoder(codec).encode(["", "", ""])[1].tolist() == [] and P.Encoder(codec).encode([]) == []


def test_edge_rows(docs, clashing, nothing):
    for df in (docs, clashing):
        found = P.encode_rows(df, MODEL)
        assert found.columns == ["doc_id", "pieces", "n_bytes", "decoded_sha256", "lossless"]
        assert found.count() == len(ROWS) and all(r["lossless"] for r in found.collect())
    assert {len(r["pieces"]) for r in P.encode_rows(docs, MODEL).collect() if r["doc_id"] in (3, 4)} == {0}
    back = P.decode_rows(P.encode_rows(docs, MODEL), MODEL)
    assert rows(back) == sorted([(r[0], r[1] or "") for r in ROWS], key=repr)
    assert P.encode_rows(nothing, MODEL).count() == 0 and P.decode_rows(P.encode_rows(nothing, MODEL), MODEL).count() == 0


def test_query_is_lossless_over_a_whole_table(spark, real):
    found = queries.op3_piece_codec(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == real.count() and all(r["lossless"] and r["n_pieces"] == len(r["pieces"]) for r in found)
