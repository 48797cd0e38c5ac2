"""Series that repeat themselves: copies settle what they can, and the results stay those of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from motifgrid.plans import copies, sampled, strategies
from tests.test_engine import got, make, same


def truth(values, m, band, half="both"):
    """``{pos: (dist, nn)}`` from the whole matrix of correlations, in integers up to the last division."""
    x = np.array([np.nan if v is None else v for v in values], float)
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    bad, w = np.isnan(w).any(axis=1), np.nan_to_num(w).astype(np.int64)
    s, i = w.sum(axis=1), np.arange(len(w))
    sd = np.sqrt((m * (w * w).sum(axis=1) - s * s).astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (m * (w @ w.T) - np.multiply.outer(s, s)).astype(float) / np.multiply.outer(sd, sd)
    r[sd == 0, :] = 0.0
    r[:, sd == 0] = 0.0
    r[np.ix_(sd == 0, sd == 0)] = 1.0
    ahead = i[None, :] - i[:, None]
    r[{"both": np.abs(ahead) <= band, "left": -ahead <= band, "right": ahead <= band}[half]] = -np.inf
    r[bad, :] = -np.inf
    r[:, bad] = -np.inf
    nn, top = r.argmax(axis=1), r.max(axis=1)
    return {k: (None, None) if top[k] == -np.inf else (np.sqrt(max(0.0, 2 * m * (1 - top[k]))), int(nn[k])) for k in range(len(w))}


def odd_series():
    """Copies at other heights, proportional windows, constant stretches, nulls, and parts that occur once."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, 50), rng.integers(0, 300, 30)
    x = [*a, *rng.integers(0, 300, 21), *(a + 7), *b, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 9, 9, 9, 9, 9, 9, 9, 9, 9, 9, *(2 * a), *b, *a, *rng.integers(0, 300, 17), *b[:20]]
    x = [int(v) for v in x]
    x[60] = x[190] = None
    return x


@pytest.fixture
def always(monkeypatch):
    monkeypatch.setattr(strategies, "COPIES_FROM", 0)


@pytest.mark.parametrize("how", ["broadcast", "shuffle"])
@pytest.mark.parametrize("m", [2, 8])
def test_copies_change_no_result(spark, always, how, m):
    x = odd_series()
    s = make(spark, x)
    for half in ("both", "left", "right"):
        same(got(strategies.matrix_profile(s, m, how, tile_size=16, half=half)), truth(x, m, m // 4, half))


@pytest.mark.parametrize("band", [2, 40])
def test_tiles_that_copies_leave(spark, band):
    """A series of four copies with something new in one: few blocks are left, and what is not settled is searched."""
    rng = np.random.default_rng(8)
    a = [int(v) for v in rng.integers(0, 900, 160)]
    x = a + a + a[:70] + [int(v) for v in rng.integers(0, 900, 9)] + a[70:] + a
    s, m, size, p = make(spark, x), 6, 8, len(x) - 5
    for half in ("both", "left", "right"):
        values, _ = strategies.centred(s, m)
        found, rest = copies.settled(strategies.blocks(values, m, size, (p - 1) // size), m, band, size, half)
        assert len(rest) < (10 if half == "both" else 40)
        made = found.unionByName(strategies.partial_rest(s, m, band, size, rest, "broadcast" if band == 2 else "shuffle", half))
        df = strategies.finished(strategies.best(made), strategies.window_positions(s, m), m)
        same(got(df), truth(x, m, band, half))


def test_classes_over_many_batches(monkeypatch):
    """A class longer than a task holds is settled in runs."""
    rng = np.random.default_rng(2)
    pos = np.unique(rng.integers(0, 500, 200))
    cid = np.zeros(len(pos), np.int64)
    for half, good in (("both", lambda i, j: abs(i - j) > 9), ("left", lambda i, j: j < i - 9), ("right", lambda i, j: j > i + 9)):
        truth = [min((j for j in pos if good(i, j)), default=-1) for i in pos]
        assert copies.least_partners(cid, pos, len(pos), None, 9, half, None).tolist() == truth
        upto = int(np.searchsorted(pos[:120], pos[119] - 9))
        parts = [copies.least_partners(cid[:120], pos[:120], upto, None, 9, half, None), copies.least_partners(cid[upto:], pos[upto:], len(pos) - upto, int(pos[0]), 9, half, None)]
        assert np.concatenate(parts).tolist() == truth


def test_early_profile_of_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a = [int(v) for v in rng.integers(0, 900, 120)]
    s = make(spark, a + a + a[:50] + a)
    plain = got(strategies.best(strategies.partial_broadcast(s, 6, 1, 16, fraction=0.5, seed=3)).selectExpr("pos", "r AS dist", "nn"))
    monkeypatch.setattr(strategies, "COPIES_FROM", 0)
    found, rest = strategies.copied(s, 6, 1, 16, early=(16, 0.5, 3))
    assert found.count() > 250
    same(got(strategies.best(strategies.partial_early(s, 6, 1, 16, 0.5, 3)).selectExpr("pos", "r AS dist", "nn")), plain)
    monkeypatch.setattr(strategies, "BROADCAST_VALUES", 100)
    same(got(strategies.best(strategies.partial_early(s, 6, 1, 16, 0.5, 3)).selectExpr("pos", "r AS dist", "nn")), plain)


def test_long_repeated_series_needs_no_search(spark):
    """400 copies of 1,000 values: every window has a copy, so no tile is left (all pairs would be 8e10 cells)."""
    df = spark.range(400_000).selectExpr("id AS pos", "cast(conv(substring(md5(cast(id % 1000 AS string)), 1, 6), 16, 10) AS bigint) % 1000 AS c")
    found, rest = strategies.copied(df, 16, 4, strategies.TILE)
    assert rest == [] and found.count() == 400_000 - 15
    assert found.filter("nn <> if(pos < 1000, pos + 1000, pos % 1000)").count() == 0


@pytest.mark.parametrize("step, period", [(4, 128), (5, 131)])
def test_sampled_pass_of_copies(spark, monkeypatch, step, period):
    """Classes' first members stand for all: the same rows as without looking for copies, with something new in one copy."""
    rng = np.random.default_rng(7)
    a = np.cumsum(rng.integers(-20, 21, period)).tolist()  # neighbouring windows are much alike
    x = a * 8 + [1, 5, 2, 8] + a[:60] + [9, 9, 9, 9, 9, 9, 9, 9, 9] + a * 13
    s, m, size = make(spark, x), 8, 16
    plain = [got(f) for f in _sampled(s, m, step, size)]
    monkeypatch.setattr(strategies, "COPIES_FROM", 0)
    members, left = sampled.condensed(s, m, step, 2, size)
    assert members.count() == len(x) - m + 1 and 2 * len(left) * size < len(x)
    for f, before in zip(_sampled(s, m, step, size), plain):
        same(got(f), before)


def _sampled(s, m, step, size):
    rows = sampled.sampled_rows(s, m, step, strategy="shuffle", size=size).selectExpr("i AS pos", "r AS dist", "nn")
    return rows, sampled.sampled_profile(s, m, step, strategy="shuffle", size=size)


def test_refined_profile_has_the_exact_ones_pairs_only(spark):
    """Smooth values, whose nearest windows are the nearest in time: the sampled pass alone admits pairs at the band's distance."""
    x = [round(100 * np.sin(k / 9) + 40 * np.sin(k / 31 + 1)) for k in range(150)]
    same(got(sampled.refined_profile(make(spark, x), 8, 3)), truth(x, 8, 2))
