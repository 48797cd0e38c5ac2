"""The profile against brute force on small series, and its edge cases."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifgrid.operators import profiles, series
from motifgrid.plans import keyed, kernel, sampled, search, strategies

HOW = ("sql", "broadcast", "shuffle")


def make(spark, values, kind="c"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"pos bigint, {kind} {'bigint' if kind == 'c' else 'double'}")


def correlation(a, b):
    if np.isnan(a).any() or np.isnan(b).any():
        return None
    flat_a, flat_b = np.ptp(a) == 0, np.ptp(b) == 0
    if flat_a or flat_b:
        return 1.0 if flat_a and flat_b else 0.0
    m = len(a)
    if (a != np.round(a)).any():  # nothing may cancel; whole values are exact as they are
        a, b = a - a.mean(), b - b.mean()
    num = m * (a * b).sum() - a.sum() * b.sum()
    return num / (np.sqrt(m * (a * a).sum() - a.sum() ** 2) * np.sqrt(m * (b * b).sum() - b.sum() ** 2))


def brute(values, m, band=None):
    """``{pos: (dist, nn)}`` by looking at every pair."""
    x = np.array([np.nan if v is None else v for v in values], float)
    p, band = len(x) - m + 1, m // 4 if band is None else band
    out = {}
    for i in range(p):
        best = None
        for j in range(p):
            if abs(i - j) > band and (r := correlation(x[i : i + m], x[j : j + m])) is not None and (best is None or r > best[0]):
                best = (r, j)
        out[i] = (None, None) if best is None else (np.sqrt(max(0.0, 2 * m * (1 - best[0]))), best[1])
    return out


def got(df):
    return {r["pos"]: (r["dist"], r["nn"]) for r in df.collect()}


def same(a, b, tolerance=0.0):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][1] == b[k][1], (k, a[k], b[k])
        assert (a[k][0] is None and b[k][0] is None) or abs(a[k][0] - b[k][0]) <= tolerance


@pytest.mark.parametrize("how", HOW)
@pytest.mark.parametrize("m", [2, 3, 5, 8])
def test_small_series(spark, how, m):
    values = np.random.default_rng(m).integers(0, 50, 60).tolist()
    same(got(strategies.matrix_profile(make(spark, values), m, how, tile_size=17)), brute(values, m), 1e-9)


@pytest.mark.parametrize("how", HOW)
def test_ties_take_the_least_neighbour(spark, how):
    values = [0, 3, 1, 4] * 12
    found = got(strategies.matrix_profile(make(spark, values), 8, how, tile_size=9))
    same(found, brute(values, 8), 1e-9)
    assert found[40][1] == 0


@pytest.mark.parametrize("how", HOW)
def test_constant_windows(spark, how):
    same(got(strategies.matrix_profile(make(spark, [7] * 30), 4, how, tile_size=7)), brute([7] * 30, 4))
    values = [*np.random.default_rng(1).integers(0, 9, 20).tolist(), *[5] * 8, *np.random.default_rng(2).integers(0, 9, 20).tolist()]
    same(got(strategies.matrix_profile(make(spark, values), 6, how, tile_size=10)), brute(values, 6), 1e-9)


@pytest.mark.parametrize("how", HOW)
def test_null_values_leave_windows_out(spark, how):
    values = np.random.default_rng(3).integers(0, 30, 50).tolist()
    values[20] = None
    found = got(strategies.matrix_profile(make(spark, values), 5, how, tile_size=11))
    assert all(found[k] == (None, None) for k in range(16, 21))
    same(found, brute(values, 5), 1e-9)


@pytest.mark.parametrize("how", HOW)
def test_shortest_series(spark, how):
    with pytest.raises(ValueError):
        strategies.matrix_profile(make(spark, [1, 2]), 3, how)
    assert got(strategies.matrix_profile(make(spark, [1, 2, 3]), 3, how)) == {0: (None, None)}
    assert got(strategies.matrix_profile(make(spark, list(range(9))), 8, how)) == {0: (None, None), 1: (None, None)}
    with pytest.raises(ValueError):
        strategies.matrix_profile(make(spark, []), 3, how)


@pytest.mark.parametrize("how", HOW[1:])
def test_general_doubles(spark, how):
    x = np.cumsum(np.random.default_rng(5).normal(size=120))
    want = brute(x, 10)
    same(got(strategies.matrix_profile(make(spark, x.tolist(), "value"), 10, how, tile_size=40)), want, 1e-6)
    same(got(strategies.matrix_profile(make(spark, (x + 1e9).tolist(), "value"), 10, how, tile_size=40)), want, 1e-3)


@pytest.mark.parametrize("n", [64, 65, 71])
def test_tile_borders(spark, n):
    values = np.random.default_rng(n).integers(0, 100, n).tolist()
    whole = got(strategies.matrix_profile(make(spark, values), 8, "broadcast", tile_size=64))
    for size in (3, 8):
        same(got(strategies.matrix_profile(make(spark, values), 8, "shuffle", tile_size=size)), whole)
        same(got(strategies.matrix_profile(make(spark, values), 8, "broadcast", tile_size=size)), whole)


@pytest.mark.parametrize("size", [16, 50, 1 << 14])
def test_diagonals_by_blocks_equal_the_joins(spark, size):
    """Nulls, constant stretches, values beyond the exact bound, and more diagonals than a block has rows."""
    rng = np.random.default_rng(12)
    x = [int(v) for v in rng.integers(0, 900, 120)]
    x[30], x[60:75] = None, [5] * 15
    for values, kind, tolerance in ((x, "c", 0.0), ([None if v is None else v * 10**5 + 1 for v in x], "c", 0.0), ([None if v is None else v / 7 for v in x], "value", 1e-9)):
        s = make(spark, values, kind)
        first, last = (3, 5) if size > 50 else (17, 40)
        rows = [{(r["i"], r["j"]): (r["r"], 0) for r in f.collect()} for f in (strategies.diagonal_cells(s, 6, first, last, size), strategies.cells_sql(s, 6, 1, first, last))]
        same(*rows, tolerance)
    assert strategies.diagonal_cells(s, 6, 400, 410, size).count() == 0


def test_diagonals_shuffle_values_only(spark):
    """No row of a cell is shuffled: blocks are made once, and cells where the blocks are."""
    from motifgrid import queries
    from tests.conftest import SF

    plan = queries.diagonal_distances(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan
    assert plan.index("MapInArrow") < plan.index("Exchange")  # plans are printed from the last step


@pytest.mark.parametrize("long", [4, 512])
def test_general_doubles_in_both_forms(long, monkeypatch):
    monkeypatch.setattr(kernel, "LONG_WINDOW", long)
    x = np.cumsum(np.random.default_rng(2).normal(size=150)) + 1e6
    x[40] = np.nan
    x[90:110] = x[90]
    _, r, nn = keyed.series_profile(x, 10, 2)
    want = brute(x, 10)
    for k, (dist, near) in want.items():
        assert (nn[k] == -1) == (near is None)
        if near is not None:
            assert abs(np.sqrt(max(0.0, 20 * (1 - r[k]))) - dist) < 1e-3


def test_squares_cover_the_triangle():
    for p, size, cores in ((1, 5, 1), (100, 7, 3), (1000, 10, 8)):
        g, side = strategies.squares(p, size, cores)
        k = -(-p // size)
        assert (g - 1) * side < k <= g * side
        found = {strategies.square_of(t, g) for t in range(g * (g + 1) // 2)}
        assert found == {(a, b) for a in range(g) for b in range(a, g)}


def test_anticorrelated_pairs_have_their_true_distance(spark):
    values = [0, 1, 2, 3, 4, 5, 4, 3, 2, 1, 0]
    same(got(strategies.matrix_profile(make(spark, values), 4, "broadcast", exclusion=5)), brute(values, 4, 5), 1e-9)


def test_halves_and_merge(spark):
    values = np.random.default_rng(9).integers(0, 60, 50).tolist()
    s, m = make(spark, values), 6
    cells = strategies.cells_sql(s, m, 1)
    whole = got(profiles.finished(profiles.best(profiles.both_sides(cells)), strategies.window_positions(s, m), m))
    both = profiles.merge(profiles.left_half(cells), profiles.right_half(cells))
    same(got(profiles.finished(both, strategies.window_positions(s, m), m)), whole)
    for half, fn in (("left", profiles.left_half), ("right", profiles.right_half)):
        same(got(strategies.matrix_profile(s, m, "broadcast", half=half, tile_size=13)), got(profiles.finished(fn(cells), strategies.window_positions(s, m), m)))


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-40, 40), min_size=12, max_size=60), st.integers(2, 6), st.integers(5, 30))
def test_kernel_properties(values, m, size):
    """The in-memory profile equals brute force for any tile size; scale and offset change nothing."""
    x = np.array(values, float)
    band = m // 4
    r = np.full(len(x) - m + 1, -np.inf)
    nn = np.full(len(r), -1)
    p = len(r)
    for i0 in range(0, p, size):
        for j0 in range(i0, p, size):
            a, b = min(size, p - i0), min(size, p - j0)
            rows, columns = kernel.Best(i0, a), kernel.Best(j0, b)
            kernel.tile(x[i0 : i0 + a + m - 1], x[j0 : j0 + b + m - 1], i0, j0, m, band, True, rows, columns)
            for best in (rows, columns):
                for pos, value, near in zip(*best.rows()):
                    if value > r[pos] or value == r[pos] and near < nn[pos]:
                        r[pos], nn[pos] = value, near
    want = brute(values, m)
    assert nn.tolist() == [-1 if v[1] is None else v[1] for v in want.values()]
    _, _, moved = keyed.series_profile(x + 100, m, band)
    assert moved.tolist() == nn.tolist()
    _, scaled, other = keyed.series_profile(3 * x + 100, m, band)  # roots of other numbers: equal up to rounding, ties may fall another way
    for k in np.flatnonzero(other != -1):
        assert abs(scaled[k] - r[k]) < 1e-12 and abs(correlation(x[k : k + m], x[other[k] : other[k] + m]) - r[k]) < 1e-12
    assert ((other == -1) == (nn == -1)).all()


def test_sampled_profile_is_never_better_than_exact(spark):
    s = make(spark, np.random.default_rng(4).integers(0, 99, 200).tolist())
    exact, rough = got(strategies.matrix_profile(s, 12)), got(sampled.sampled_profile(s, 12, 5))
    assert all(rough[k][0] is None or rough[k][0] >= exact[k][0] for k in exact)
    same(got(sampled.sampled_profile(s, 12, 1, exclusion=4)), got(strategies.matrix_profile(s, 12, exclusion=3)))
    for how in ("auto", "shuffle", "sql"):
        same(got(sampled.refined_profile(s, 12, 5, strategy=how)), exact)
    with pytest.raises(ValueError):
        sampled.sampled_profile(s, 12, 0)


def test_positions(spark):
    rows = spark.createDataFrame([(k * 7 % 1000, float(k)) for k in range(1000)], "k bigint, v double")
    want = [(j, v) for j, (_, v) in enumerate(sorted((r["k"], r["v"]) for r in rows.collect()))]
    assert sorted(map(tuple, series.with_positions(rows, "k", "v").collect())) == want
    for ranges in (1, 7, 200):
        assert sorted(map(tuple, series.with_positions(rows, "k", "v", ranges=ranges).collect())) == want
    with pytest.raises(ValueError):
        series.with_positions(rows.union(rows), "k", "v")


def test_positions_of_a_key_that_repeats(spark):
    """Equal times are no error where a tie-breaker is named; rows equal in all stand in the order of their values."""
    rows = [(5, 2, 1.0), (3, 9, 2.0), (5, 1, 3.0), (3, 9, 1.0), (None, 4, 7.0)]
    df = spark.createDataFrame(rows, "ts bigint, id bigint, value double")
    with pytest.raises(ValueError):
        series.with_positions(df, "ts", "value")
    assert sorted(map(tuple, series.with_positions(df, "ts", "value", ties=("id",)).collect())) == [(0, 7.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 1.0)]


def test_repeated_events_keep_their_timestamp_positions(spark, duck, tmp_path):
    """A table that holds every event twice, under another id."""
    from motifgrid import queries

    once = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    once.unionByName(once.withColumn("event_id", F.col("event_id") + 10_000)).write.parquet(f"{tmp_path}/events.parquet")
    found = sorted(map(tuple, queries.timestamp_positions(spark, str(tmp_path)).collect()))
    sql = queries.ORACLE_SQL["timestamp_positions"].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert len(found) == 2000 and found == sorted(duck.execute(sql).fetchall())


@pytest.mark.parametrize("block", [10, 16, 1000])
def test_window_sums_by_blocks(spark, block):
    x = np.random.default_rng(6).integers(-50, 50, 100)
    found = {r["pos"]: (r["s0"], r["q0"]) for r in series.window_sums(make(spark, x.tolist()), 10, block).collect()}
    assert found == {k: (int(x[k : k + 10].sum()), int((x[k : k + 10] ** 2).sum())) for k in range(91)}
    cum = {r["pos"]: r["cum"] for r in series.prefix_sums(make(spark, x.tolist()), block).collect()}
    assert cum == dict(enumerate(np.cumsum(x).tolist()))


def test_exactness_bound(spark):
    assert series.fits_exactly(make(spark, [0, 56_021]), 50_000)
    assert not series.fits_exactly(make(spark, [0, 2_300_000_000]), 2)
    assert not series.fits_exactly(make(spark, [-1, 2_200_000]), 1000)


def test_long_keys_take_the_tile_plan(spark):
    rng = np.random.default_rng(8)
    rows = [(u, k, float(v)) for u in (1, 2) for k, v in enumerate(rng.integers(0, 40, 30 * u))] + [(None, 1, 1.0), (3, 1, 1.0)]
    df = spark.createDataFrame(rows, "u bigint, o bigint, v double")
    a = sorted(map(tuple, keyed.keyed_profiles(df, "u", "o", "v", 5).collect()))
    assert a == sorted(map(tuple, keyed.keyed_profiles(df, "u", "o", "v", 5, key_rows=40).collect()))
    assert {r[0] for r in a} == {1, 2}


def test_compare_and_pairs(spark):
    a = spark.createDataFrame([(0, 1.0, 3), (1, 2.0, 4), (2, 0.5, 0)], "pos bigint, dist double, nn bigint")
    b = spark.createDataFrame([(0, 1.5, 3), (1, 2.0, 5), (4, 0.0, 0)], "pos bigint, dist double, nn bigint")
    assert tuple(profiles.compare(a, b).first()) == (1, 0.5, 1, 1)
    names = ["matprof_v1_l9m3alg#sequential#_p1_x", "matprof_v1_l9m3alg#tiles#_p4_x", "matprof_v2_l9m3alg#tiles#_p1_x", "matprof_v2_l9m3alg#tiles#_p2_x", "other"]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    assert {(r["baseline"], r["other"]) for r in profiles.pair_runs(files).collect()} == {(names[0], names[1]), (names[2], names[3])}


def test_motifs_and_discords(spark):
    p = spark.createDataFrame([(0, 1.0, 3), (1, None, None), (2, 0.5, 0), (3, 9.0, 0)], "pos bigint, dist double, nn bigint")
    assert [r["pos"] for r in profiles.motifs(p, 2).collect()] == [2, 0]
    assert [r["pos"] for r in profiles.discords(p, 1).collect()] == [3]


def test_early_approximation(spark):
    s = make(spark, np.random.default_rng(4).integers(0, 99, 300).tolist())
    part = profiles.best(strategies.partial_broadcast(s, 10, 2, 32, fraction=0.5, seed=1))
    whole = {r["pos"]: r["r"] for r in profiles.best(strategies.partial_broadcast(s, 10, 2, 32)).collect()}
    assert all(r["r"] <= whole[r["pos"]] for r in part.collect()) and part.filter(F.col("r").isNull()).count() == 0


@pytest.mark.parametrize("block", [16, 1000])
def test_similarity_search(spark, block):
    x = np.random.default_rng(7).integers(0, 90, 150)
    x[60:75] = 4
    for s, values in ((make(spark, x.tolist()), x), (make(spark, (x / 7).tolist(), "value"), x / 7)):
        found = {r["pos"]: r["r"] for r in search.search(s, values[20:30].tolist(), block).collect()}
        want = {k: correlation(values[20:30], values[k : k + 10]) for k in range(141)}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-7 for k in want)
        row = search.distance_row(s, 20, 10, block=block)
        assert row.count() == 141 - 3
    with pytest.raises(ValueError):
        search.distance_row(s, 145, 10)


def whole_brute(values, m):
    """The profile by integers of any size: pairs compare by sign and square of covariance over the variances' product."""
    p, band = len(values) - m + 1, m // 4
    w = [values[i : i + m] for i in range(p)]
    s = [sum(x) for x in w]
    v = [m * sum(a * a for a in x) - t * t for x, t in zip(w, s)]
    out = {}
    for i in range(p):
        best = None
        for j in range(p):
            if abs(i - j) <= band:
                continue
            if v[i] == 0 or v[j] == 0:
                r = Fraction(int(v[i] == v[j] == 0))
            else:
                c = m * sum(a * b for a, b in zip(w[i], w[j])) - s[i] * s[j]
                r = Fraction(c * abs(c), v[i] * v[j])  # the sign and square of the correlation
            if best is None or r > best[0]:
                best = (r, j)
        out[i] = (None, None) if best is None else (np.sqrt(max(0.0, 2 * m * (1 - np.copysign(np.sqrt(abs(float(best[0]))), float(best[0]))))), best[1])
    return out


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(2, 100), st.integers(-(10**12), 10**12), st.integers(1, 400), st.integers(0, 10**6), st.integers(20, 200))
def test_offsets_change_nothing_in_the_kernel(m, offset, spread, seed, more):
    x = np.random.default_rng(seed).integers(0, spread + 1, m + more)
    small, big = keyed.series_profile(x, m, m // 4), keyed.series_profile(x + offset, m, m // 4)
    assert kernel.prepared(x + offset, m)[1]
    for a, b in zip(small, big):
        assert np.array_equal(a, b, equal_nan=True)


@pytest.mark.parametrize("m,offset", [(2, 10**12), (8, 10_000_000), (8, -(10**9)), (30, 10**12), (64, 123_456_789)])
def test_every_strategy_is_exact_on_large_whole_values(spark, m, offset):
    values = [int(v) + offset for v in np.random.default_rng(m).integers(0, 50, m + 90)]
    s, want = make(spark, values), whole_brute(values, m)
    for how in HOW:
        same(got(strategies.matrix_profile(s, m, how, tile_size=37)), want, 1e-6)
    same(got(sampled.sampled_profile(s, m, 1, exclusion=m // 4 + 1)), want, 1e-6)
    same(got(sampled.sampled_profile(s, m, 1, exclusion=m // 4 + 1, strategy="shuffle", size=37)), want, 1e-6)
    rows = s.selectExpr("1 AS u", "pos AS o", "c AS v")
    for limit in (10**6, 10):
        same({r["pos"]: (r["dist"], r["nn"]) for r in keyed.keyed_profiles(rows, "u", "o", "v", m, key_rows=limit).collect()}, want, 1e-6)
    found = {r["pos"]: r["dist"] for r in search.distance_row(s, 5, m, block=40).collect()}
    near = want[5][1]
    assert found[near] == min(found[k] for k in found if abs(k - 5) > m // 4)
    with_doubles = s.select("pos", (F.col("c") - offset).cast("double").alias("value"))
    for how in HOW:
        for k, (dist, _) in got(strategies.matrix_profile(with_doubles, m, how, tile_size=37)).items():
            assert abs(dist - want[k][0]) < 1e-5


def test_the_reported_case_of_a_long_series(spark):
    """4,200 values of 0..49, m = 8: ten million more on each value changes no neighbour."""
    x = np.random.default_rng(0).integers(0, 50, 4200)
    a, b = (got(strategies.matrix_profile(make(spark, (x + k).tolist()), 8, "broadcast")) for k in (0, 10_000_000))
    assert a == b
    assert got(strategies.matrix_profile(make(spark, (x + 10_000_000).tolist()), 8, "shuffle")) == a


@pytest.mark.parametrize("how", HOW)
def test_values_beyond_the_exact_bound(spark, how):
    """A range too wide for exact sums: general doubles, near the truth."""
    values = [int(v) for v in np.random.default_rng(3).integers(-(10**12), 10**12, 80)]
    want = whole_brute(values, 8)
    for k, (dist, _) in got(strategies.matrix_profile(make(spark, values), 8, how, tile_size=30)).items():
        assert abs(dist - want[k][0]) < 1e-6


@pytest.mark.parametrize("how", HOW)
def test_missing_and_infinite_doubles(spark, how):
    x = np.random.default_rng(4).normal(size=60)
    x[20], x[40] = np.nan, np.inf
    values = x.tolist()
    values[50] = None
    clean = [None if v is None or not np.isfinite(v) else v for v in values]
    same(got(strategies.matrix_profile(make(spark, values, "value"), 6, how, tile_size=20)), brute(clean, 6), 1e-7)


@pytest.mark.parametrize("step,m,size", [(3, 12, 50), (5, 8, 16), (16, 10, 64), (1, 6, 33)])
def test_sampled_pass_by_blocks_equals_the_broadcast_one(spark, step, m, size):
    r = np.random.default_rng(step)
    whole = r.integers(0, 40, 230).tolist()
    whole[60:90], whole[120] = [5] * 30, None
    for s in (make(spark, whole), make(spark, np.cumsum(r.normal(size=230)).tolist(), "value")):
        same(got(sampled.sampled_profile(s, m, step, strategy="shuffle", size=size)), got(sampled.sampled_profile(s, m, step, strategy="broadcast")), 1e-9)
        a, b = (sorted(map(tuple, sampled.sampled_rows(s, m, step, strategy=h, size=size).select("i", F.round("r", 9), "nn").collect())) for h in ("shuffle", "broadcast"))
        assert a == b


def test_squares_are_bounded():
    g, side = strategies.squares(10**9, strategies.TILE, 16)
    assert side * strategies.TILE <= strategies.SIDE_VALUES and g * side * strategies.TILE >= 10**9
    for g in (1, 2, 7, 1000):
        tasks = g * (g + 1) // 2
        for t in {0, 1, tasks // 3, tasks - 1} & set(range(tasks)):
            row, column = strategies.square_of(t, g)
            assert 0 <= row <= column < g and row * g - row * (row - 1) // 2 + column - row == t


def test_positions_of_any_key(spark):
    """Null keys come first at every size; any orderable type; thousands of ranges in one plan of fixed size."""
    for n in (5, 3000):
        rows = spark.range(n).selectExpr("CASE WHEN id = 3 THEN NULL ELSE timestamp_seconds(id * 7919 % 100003) END AS t", "CASE WHEN id = 3 THEN NULL ELSE cast(id * 7919 % 100003 AS string) END AS s", "CASE WHEN id = 3 THEN NULL ELSE cast(id * 7919 % 100003 AS decimal(20, 2)) END AS d", "id AS v")
        for key in ("t", "s", "d"):
            found = series.with_positions(rows, key, "v", ranges=None if n < 10 else 60).collect()
            order = [r["v"] for r in rows.orderBy(key).collect()]
            assert [r["value"] for r in sorted(found, key=lambda r: r["pos"])] == order and order[0] == 3
        twice = rows.unionByName(rows.filter("id = 3") if "id" in rows.columns else rows.filter("v = 3"))
        with pytest.raises(ValueError):
            series.with_positions(twice, "t", "v")
    placed = spark.range(20_000).select((F.shiftleft(F.expr("id div 4"), 33) + F.col("id") % 4).alias("__at"), F.col("id").alias("value"))
    assert series.numbered(placed).filter("pos <> value").isEmpty()
    assert series.with_positions(spark.range(0).selectExpr("id AS k", "id AS v"), "k", "v").count() == 0


def test_tied_order_values_have_one_rule(spark):
    """Equal order values stand in the order of their values, for short and long keys alike."""
    r = np.random.default_rng(1)
    rows = [(u, int(k) // 3, float(v)) for u in (1, 2) for k, v in enumerate(r.integers(0, 9, 60))] + [(1, None, 4.0)]
    df = spark.createDataFrame(rows, "u bigint, o bigint, v double")
    a, b = (sorted(map(tuple, keyed.keyed_profiles(df.repartition(k), "u", "o", "v", 6, key_rows=limit).collect())) for k, limit in ((3, 1000), (5, 10)))
    assert a == b and len(a) == 56 + 55


def test_sums_of_large_values(spark):
    x = [3_000_000_000 + k * k for k in range(200)]
    found = {r["pos"]: (r["s0"], r["q0"]) for r in series.window_sums(make(spark, [v // 100 for v in x]), 5, 64).collect()}
    y = [v // 100 for v in x]
    assert found == {k: (sum(y[k : k + 5]), sum(v * v for v in y[k : k + 5])) for k in range(196)}
