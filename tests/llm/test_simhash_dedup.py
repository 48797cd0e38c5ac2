from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from motifgrid.llm import queries
from motifgrid.llm import simhash_dedup as S
from tests.llm.conftest import ROWS, rows


def plain_simhash(text):
    """The contract, word by word."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, held = [], ""
    for c in lowered + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words += [held] if held else []
            held = ""
        else:
            held += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(pairs):
    """``{(id, fingerprint): component}`` for rows of (id, fingerprint)."""
    parent = list(range(len(pairs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, f, least.get(find(k))) for k, (i, f) in enumerate(pairs)], key=repr)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \t\n\x0b\x1cé ", max_size=60))
def test_fingerprint(text):
    assert S.simhash(text) == plain_simhash(text)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('ab cd ef')").first()[0] == S._signed(xxhash.xxh64_intdigest(b"ab cd ef", 42))


@pytest.mark.parametrize("node_rows", [20_000, 3])
def test_edge_rows(docs, clashing, node_rows):
    want = brute([(r[0], plain_simhash(r[1])) for r in ROWS])
    for df in (docs, clashing):
        found = [(a, b % 2**64, c) for a, b, c in rows(S.near_duplicates(df, node_rows=node_rows))]
        assert sorted(found, key=repr) == want


def test_query_over_a_whole_table(spark, real):
    found = queries.op10_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    want = brute([(r["doc_id"], plain_simhash(r["text"])) for r in real.collect()])
    assert sorted([(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in found], key=repr) == want


@pytest.mark.parametrize("node_rows", [20_000, 40])
def test_chains_and_dense_groups(spark, node_rows):
    rng = np.random.default_rng(0)
    x = [rng.integers(0, 2**63, 60, dtype=np.uint64)]
    for _ in range(6):  # chains that drift apart step by step
        x.append(x[-1] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    centre = np.uint64(0x0F0F0F0F12345678)
    x.append(centre ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)))  # all within two bits of each other
    fps = np.unique(np.concatenate(x))
    v = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    member = {r["node"]: r["root"] for r in S.components(S.link_forest(v, node_rows=node_rows)).collect()}
    groups = {}
    for k, f in enumerate(fps.view(np.int64).tolist()):
        groups.setdefault(member.get(f, f), set()).add(k)
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 2):
            parent[find(a)] = find(int(b))
    want = {}
    for k in range(len(fps)):
        want.setdefault(find(k), set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_index_finds_every_link():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64))
    fps = fps[np.argsort(S.gray_rank(fps))]
    found = {tuple(sorted(p)) for a, b in S.gray_links(fps, np.zeros(len(fps), int)) for p in zip(a.tolist(), b.tolist())}
    assert found == {(a, int(b)) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 2) if a < b}


def test_masks_cover_the_word():
    for level in S.mask_tree():
        for parent, children in level.items():
            free = [c & ~parent for c in children]
            assert sum(free) == (2**64 - 1) & ~parent


def test_keep_one(docs, clashing, nothing):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-5, 1, 3, 6, 7, 8, 9] and ids.count(None) == 2
    assert S.keep_one(clashing).columns == clashing.columns and S.keep_one(clashing).count() == kept.count()
    assert S.keep_one(nothing).count() == 0 and S.near_duplicates(nothing).count() == 0
    repeated = S.keep_one(docs.filter("doc_id = 2"))
    assert repeated.count() == 1
