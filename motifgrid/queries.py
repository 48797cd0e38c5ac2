"""Registered queries of the similarity engine and their DuckDB SQL.

Series come from whole tables: E is ``events.value`` in cents by event, Q the
quantity shipped a day, C the orders a day. All are whole numbers, so Spark and
DuckDB compute the same doubles in the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifgrid.operators import profiles, series
from motifgrid.operators.series import to_fixed, with_positions
from motifgrid.functions import udtf
from motifgrid.functions.expressions import direct_dist2, dot_from_dist2, factored_score, score_to_dist2
from motifgrid.plans import keyed, partitioning, sampled, search, strategies
from motifgrid.sources import files, generate
from motifgrid.storage import fresh_path
from motifgrid.streaming.append import ProfileStream

#: Window lengths of the three series and of the series by user; sampling step; lag and row of the single-lag queries.
M, M_DAILY, M_USER, STEP, LAG, ROW = 64, 28, 8, 16, 100, 100
#: Offset of the shifted series; part, seed and tile of the early profile; length, motifs' length and copies of the generated walk.
OFFSET, PART, PART_SEED, PART_TILE = 10_000_000, 0.5, 3, 1000
WALK, WALK_MOTIF, WALK_COPIES = 20_000, 100, [3, 2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_fixed(with_positions(table(spark, sf_dir, "events"), "event_id", "value"), 100)


def quantity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "lineitem").groupBy(F.unix_date(F.to_date("l_shipdate")).alias("day")).agg(F.sum("l_quantity").alias("v"))
    return to_fixed(with_positions(daily, "day", "v", check=False))


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.unix_date(F.to_date("o_orderdate")).alias("day")).agg(F.count("*").alias("v"))
    return to_fixed(with_positions(daily, "day", "v", check=False))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names or ("dist",)})


# --- building blocks ----------------------------------------------------------------------


def series_positions(spark, d):
    return events_series(spark, d)


def prefix_sums(spark, d):
    return series.prefix_sums(events_series(spark, d))


def window_sums(spark, d):
    return series.window_sums(events_series(spark, d), M)


def window_mean_std(spark, d):
    return series.mean_std(events_series(spark, d), M, 100)  # not rounded: means fall on halves of the last digit


def scaled_stats(spark, d):
    return rounded(series.scaled_stats(events_series(spark, d), M, 100), "inv_sd", "scaled_mean")


def lag_product(spark, d):
    return series.lag_product(events_series(spark, d), LAG)


def initial_dotproducts(spark, d):
    return search.first_dots(events_series(spark, d), M)


def diagonal_dotproducts(spark, d):
    return series.diagonal_dots(events_series(spark, d), M, LAG)


def diagonal_cumulative(spark, d):
    return series.diagonal_cumulative(events_series(spark, d), M, LAG)


def distance_row(spark, d):
    """One window against all others."""
    return rounded(search.distance_row(events_series(spark, d), ROW, M)).withColumnRenamed("pos", "j")


def similarity_search(spark, d):
    """The same over many small blocks: the similarity search."""
    return rounded(search.distance_row(events_series(spark, d), ROW, M, block=3000))


def dot_from_distance(spark, d):
    """Dot products of a diagonal got back from its distances and the window statistics."""
    e = events_series(spark, d)
    cells = strategies.diagonal_cells(e, M, LAG, LAG).select("i", "j", profiles.correlation_to_dist2(F.col("r"), M).alias("d2"))
    st = series.mean_std(e, M, 100)
    a, b = (st.select(F.col("pos").alias(k), F.col("mean").alias(f"m_{k}"), F.col("sd").alias(f"s_{k}")) for k in ("i", "j"))
    back = dot_from_dist2(F.col("d2"), F.col("m_i"), F.col("s_i"), F.col("m_j"), F.col("s_j"), M)
    return cells.join(a, "i").join(b, "j").select("i", F.round(back * 10_000).cast("bigint").alias("dot"))


def diagonal_distances(spark, d):
    """Cells of ten diagonals, as squared distances."""
    cells = strategies.diagonal_cells(events_series(spark, d), M, LAG, LAG + 9)
    return rounded(cells.select("i", "j", profiles.correlation_to_dist2(F.col("r"), M).alias("dist2")), "dist2")


def score_forms(spark, d):
    """Cells of a diagonal by the factored score, its distance, and the direct distance formula."""
    e = events_series(spark, d)
    st = series.mean_std(e, M, 100).join(series.scaled_stats(e, M, 100), "pos")
    a, b = (st.select(F.col("pos").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("mean", "sd", "inv_sd", "scaled_mean")]) for k in ("i", "j"))
    dots = series.diagonal_dots(e, M, LAG).select("i", (F.col("i") + LAG).alias("j"), (F.col("dot") / F.lit(10_000.0)).alias("dot"))
    both = dots.join(a, "i").join(b, "j").withColumn("score", factored_score(F.col("dot"), F.col("inv_sd_i"), F.col("inv_sd_j"), F.col("scaled_mean_i"), F.col("scaled_mean_j")))
    direct = direct_dist2(F.col("dot"), F.col("mean_i"), F.col("sd_i"), F.col("mean_j"), F.col("sd_j"), M)
    return rounded(both.select("i", "score", score_to_dist2(F.col("score"), M).alias("dist2"), direct.alias("direct")), "score", "dist2", "direct")


def timestamp_positions(spark, d):
    """Positions in the order of the events' time; events of the same time stand in the order of their ids."""
    return to_fixed(with_positions(table(spark, d, "events"), "ts", "value", ties=("event_id",)), 100)


# --- profiles -----------------------------------------------------------------------------


def matrix_profile(spark, d):
    return rounded(strategies.matrix_profile(events_series(spark, d), M, "broadcast"))


def matrix_profile_shuffle(spark, d):
    return rounded(strategies.matrix_profile(events_series(spark, d), M, "shuffle"))


def matrix_profile_squared(spark, d):
    return rounded(strategies.matrix_profile(events_series(spark, d), M, squared=True))


def matrix_profile_sql(spark, d):
    return rounded(strategies.matrix_profile(quantity_series(spark, d), M_DAILY, "sql"))


def left_profile(spark, d):
    """The best earlier partner of every position; nulls where there is none."""
    return rounded(strategies.matrix_profile(events_series(spark, d), M, half="left"))


def right_profile(spark, d):
    """The best later partner of every position; nulls where there is none."""
    return rounded(strategies.matrix_profile(events_series(spark, d), M, half="right"))


def _shifted(spark, d):
    return events_series(spark, d).select("pos", (F.col("c") + OFFSET).alias("c"))


def shifted_profile(spark, d):
    """Short windows of large whole values: an offset changes no distance."""
    return rounded(strategies.matrix_profile(_shifted(spark, d), M_USER, "broadcast"))


def shifted_profile_shuffle(spark, d):
    return rounded(strategies.matrix_profile(_shifted(spark, d), M_USER, "shuffle"))


def shifted_search(spark, d):
    return rounded(search.distance_row(_shifted(spark, d), ROW, M_USER))


def _doubles(spark, d):
    """The quantities a day as general doubles: a factor and an offset change no distance."""
    return quantity_series(spark, d).select("pos", (F.col("c") / 7 + 0.1).alias("value"))


def doubles_profile_sql(spark, d):
    return rounded(strategies.matrix_profile(_doubles(spark, d), M_DAILY, "sql"))


def doubles_profile_broadcast(spark, d):
    return rounded(strategies.matrix_profile(_doubles(spark, d), M_DAILY, "broadcast"))


def doubles_profile_shuffle(spark, d):
    return rounded(strategies.matrix_profile(_doubles(spark, d), M_DAILY, "shuffle"))


def early_profile(spark, d):
    """The best over a random half of the tiles: what an early stop gives."""
    e = events_series(spark, d)
    partial = strategies.partial_early(e, M, M // 4, PART_TILE, PART, PART_SEED)
    return rounded(profiles.finished(profiles.best(partial), strategies.window_positions(e, M), M))


def profile_counters(spark, d):
    """Cells that the tasks evaluated, and whether there were as many updates of a best partner as positions."""
    q = quantity_series(spark, d)
    df, seen = strategies.counted_profile(q, M_DAILY)
    positions, partners = df.agg(F.count("*"), F.count("nn")).first()  # the counters are there once the profile has been read
    found = seen.get
    return spark.range(1).select(F.lit(positions).alias("positions"), F.lit(partners).alias("partners"), F.lit(found["cells"]).cast("bigint").alias("cells"), F.lit(found["updates"] >= positions).alias("all_updated"))


def table_function_profile(spark, d):
    """The profile in SQL, by the table function."""
    udtf.register(spark, "matrix_profile")
    quantity_series(spark, d).createOrReplaceTempView("motifgrid_quantities")
    return rounded(spark.sql(f"SELECT * FROM matrix_profile(TABLE(SELECT pos, c AS value FROM motifgrid_quantities) WITH SINGLE PARTITION ORDER BY (pos), {M_DAILY})"))


def streamed_profile(spark, d):
    """The profile after three micro-batches, each by a stream that starts on the folder of the one before."""
    q, folder = quantity_series(spark, d), fresh_path(spark, "stream")
    n = strategies.checked_length(q, M_DAILY)
    cuts = [0, n // 3, n // 2, n]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        ProfileStream(spark, folder, M_DAILY, tile_size=512).update(q.filter((F.col("pos") >= a) & (F.col("pos") < b)), k)
    return rounded(ProfileStream(spark, folder, M_DAILY).profile())


def merge_profiles(spark, d):
    """Partial profiles of two ranges of diagonals, merged."""
    q = quantity_series(spark, d)
    p, band = strategies.checked_length(q, M_DAILY) - M_DAILY + 1, M_DAILY // 4
    half = p // 2
    low, high = (profiles.both_sides(strategies.cells_sql(q, M_DAILY, band, a, b)) for a, b in ((band + 1, half), (half + 1, p - 1)))
    return rounded(profiles.finished(profiles.merge(low, high), strategies.window_positions(q, M_DAILY), M_DAILY))


def sampled_rows(spark, d):
    found = sampled.sampled_rows(events_series(spark, d), M, STEP)
    return rounded(found.select("i", profiles.correlation_to_dist(F.col("r"), M).alias("dist"), "nn"))


def sampled_profile(spark, d):
    return rounded(sampled.sampled_profile(events_series(spark, d), M, STEP))


def sampled_profile_shuffle(spark, d):
    return rounded(sampled.sampled_profile(events_series(spark, d), M, STEP, strategy="shuffle"))


def sampled_rows_shuffle(spark, d):
    found = sampled.sampled_rows(events_series(spark, d), M, STEP, strategy="shuffle")
    return rounded(found.select("i", profiles.correlation_to_dist(F.col("r"), M).alias("dist"), "nn"))


def refined_profile(spark, d):
    return rounded(sampled.refined_profile(events_series(spark, d), M, STEP))


def daily_quantity_profile(spark, d):
    return rounded(strategies.matrix_profile(quantity_series(spark, d), M_DAILY))


def daily_order_counts_profile(spark, d):
    return rounded(strategies.matrix_profile(orders_series(spark, d), M_DAILY))


def user_profiles(spark, d):
    return rounded(keyed.keyed_profiles(table(spark, d, "events"), "user_id", "event_id", "value", M_USER, 100))


def user_profiles_by_blocks(spark, d):
    """The same with every user above 60 events as a long key."""
    return rounded(keyed.keyed_profiles(table(spark, d, "events"), "user_id", "event_id", "value", M_USER, 100, key_rows=60))


def compare_profiles(spark, d):
    q = quantity_series(spark, d)
    return rounded(profiles.compare(strategies.matrix_profile(q, M_DAILY), sampled.sampled_profile(q, M_DAILY, 7)), "max_abs_diff")


def validate_summary(spark, d):
    q = quantity_series(spark, d)
    results = {"sql": strategies.matrix_profile(q, M_DAILY, "sql"), "broadcast": strategies.matrix_profile(q, M_DAILY, "broadcast", tile_size=700), "shuffle": strategies.matrix_profile(q, M_DAILY, "shuffle", tile_size=512)}
    return rounded(profiles.validate(results, "sql"), "max_abs_diff")


def top_motifs(spark, d):
    return rounded(profiles.motifs(strategies.matrix_profile(quantity_series(spark, d), M_DAILY), 10))


def top_discords(spark, d):
    return rounded(profiles.discords(strategies.matrix_profile(quantity_series(spark, d), M_DAILY), 10))


# --- partitioning -------------------------------------------------------------------------


def split_work(spark, d):
    return partitioning.split_work(spark, 7, 9937)


def balanced_pairs(spark, d):
    return partitioning.balanced_pairs(spark, 6, 9920)


def diagonal_blocks(spark, d):
    return partitioning.diagonal_blocks(spark, 9920, 500)


def triangle_tiles(spark, d):
    return partitioning.triangle_tiles(spark, 9)


def tile_ranks(spark, d):
    return partitioning.tile_ranks(spark, 9)


def tile_geometry(spark, d):
    lengths = table(spark, d, "events").agg(F.count("*").alias("n"))
    return partitioning.tile_geometry(spark, lengths, M, 7)


# --- files and generators -----------------------------------------------------------------


def ascii_roundtrip(spark, d):
    path = fresh_path(spark, "series") + ".ascii"
    files.write_series(events_series(spark, d).select("pos", (F.col("c") / 100).alias("value")), path)
    return files.read_series(spark, path)


def bin_roundtrip(spark, d):
    path = fresh_path(spark, "series") + ".bin"
    files.write_series(events_series(spark, d).select("pos", (F.col("c") / 100).alias("value")), path)
    return files.read_series(spark, path, partitions=4)


def profile_roundtrip(spark, d):
    """A profile through binary and text files."""
    one, two = fresh_path(spark, "profile") + ".bin", fresh_path(spark, "profile") + ".ascii"
    files.write_profile(strategies.matrix_profile(quantity_series(spark, d), M_DAILY), one)
    files.convert_profile(spark, one, two)
    return rounded(files.read_profile(spark, two))


def chunked_profile(spark, d):
    """A profile written and read a hundred rows at a time."""
    path = fresh_path(spark, "profile") + ".bin"
    files.write_profile(strategies.matrix_profile(quantity_series(spark, d), M_DAILY), path, chunk_rows=100)
    return rounded(files.read_profile(spark, path, chunk_rows=100))


def _events_file(spark, d, end: str) -> str:
    path = fresh_path(spark, "series") + end
    files.write_series(events_series(spark, d).select("pos", (F.col("c") / 100).alias("value")), path)
    return path


def series_slice(spark, d):
    """Positions 1000 to 1499 of a binary file (all from 500 on if it is shorter)."""
    path = _events_file(spark, d, ".bin")
    first = min(1000, files.series_length(spark, path) - 500)
    return files.read_series(spark, path, offset=first, length=500, partitions=3)


def series_length(spark, d):
    """Lengths from the header of a binary file and by counting a text file."""
    rows = [(e, files.series_length(spark, _events_file(spark, d, f".{e}"))) for e in ("ascii", "bin")]
    return spark.createDataFrame(rows, "format string, n bigint")


def series_converted(spark, d):
    """Text to binary and back to text, by default names."""
    first = _events_file(spark, d, ".ascii")
    second = files.convert_series(spark, first)
    third = files.convert_series(spark, second, fresh_path(spark, "series") + ".ascii")
    return files.read_series(spark, third)


def profile_converted(spark, d):
    """A text profile converted to binary."""
    one = fresh_path(spark, "profile") + ".ascii"
    files.write_profile(strategies.matrix_profile(quantity_series(spark, d), M_DAILY), one)
    return rounded(files.read_profile(spark, files.convert_profile(spark, one)))


def paired_runs(spark, d):
    """Which result files are compared with which, for files named after the nations."""
    algo = F.element_at(F.array(F.lit("tiles"), F.lit("sequential"), F.lit("blocks")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    algo = F.when(F.col("n_regionkey") < 3, algo).otherwise("tiles")
    name = F.concat(F.lit("matprof_v"), F.col("n_regionkey"), F.lit("_l100m8_alg#"), algo, F.lit("#_p"), F.col("n_nationkey"), F.lit("_x.bin"))
    return profiles.pair_runs(table(spark, d, "nation").select(name.alias("file")))


def folder_validation(spark, d):
    """The summary over a folder with results of three algorithms."""
    q, folder = quantity_series(spark, d), fresh_path(spark, "results")
    for name, how in (("sequential#_p1", "sql"), ("tiles#_p4", "broadcast"), ("blocks#_p8", "shuffle")):
        files.write_profile(strategies.matrix_profile(q, M_DAILY, how), f"{folder}/matprof_v1_l2500m{M_DAILY}_alg#{name}_x.bin")
    found = files.validate_folder(spark, folder, need_baseline=True)[1]
    shown = {k: ",".join(v) if isinstance(v, list) else v for k, v in found.items()}
    return spark.createDataFrame([tuple(shown.values())], "files bigint, configs bigint, algorithms string, process_counts string, lengths string, windows string, pairs bigint, differences bigint, max_abs_diff double")


def next_counts(spark, d):
    """Scaling runs from 1 to 40 with bases 2 and 3."""
    rows = [(mode, base, n, partitioning.next_process_count(n, mode, base)) for mode in ("linear", "square", "exp", "square_exp") for base in (2, 3) for n in range(1, 41)]
    return spark.createDataFrame(rows, "mode string, base int, current int, next bigint")


def planted_places(spark, d):
    """Where the generator plants its motifs."""
    return rounded(generate.places_table(spark, generate.choose_places(WALK, WALK_MOTIF, WALK_COPIES)), "scale")


def random_embeddings(spark, d):
    """Random multiplicities for the first hundred seeds."""
    rows = [(seed, motif, many) for seed in range(100) for motif, many in enumerate(generate.choose_embeddings(WALK, WALK_MOTIF, seed))]
    return spark.createDataFrame(rows, "seed int, motif int, many int")


def generated_walk(spark, d):
    made = generate.generate(spark, WALK, WALK_MOTIF, WALK_COPIES)[0]
    return made.select("pos", F.round("value", 3).alias("value"))  # sums of doubles in another order


def generated_noise(spark, d):
    return rounded(generate.generate(spark, WALK, WALK_MOTIF, WALK_COPIES, "noise")[0], "value")


QUERIES = {f.__name__: f for f in (
    series_positions, timestamp_positions, prefix_sums, window_sums, window_mean_std, scaled_stats, lag_product, initial_dotproducts, diagonal_dotproducts, diagonal_cumulative, distance_row, similarity_search, dot_from_distance, diagonal_distances, score_forms,
    matrix_profile, matrix_profile_shuffle, matrix_profile_squared, matrix_profile_sql, left_profile, right_profile, merge_profiles, sampled_rows, sampled_rows_shuffle, sampled_profile, sampled_profile_shuffle, refined_profile,
    shifted_profile, shifted_profile_shuffle, shifted_search, doubles_profile_sql, doubles_profile_broadcast, doubles_profile_shuffle, early_profile, profile_counters, table_function_profile, streamed_profile,
    daily_quantity_profile, daily_order_counts_profile, user_profiles, user_profiles_by_blocks, compare_profiles, validate_summary, folder_validation, paired_runs, top_motifs, top_discords,
    split_work, balanced_pairs, diagonal_blocks, triangle_tiles, tile_ranks, tile_geometry, next_counts, ascii_roundtrip, bin_roundtrip, profile_roundtrip, chunked_profile, series_slice, series_length, series_converted, profile_converted,
    planted_places, random_embeddings, generated_walk, generated_noise,
)}


# --- DuckDB SQL ---------------------------------------------------------------------------

E = "s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, round(value * 100)::BIGINT AS c FROM events)"
Q = "s AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, c FROM (SELECT l_shipdate::DATE AS day, round(sum(l_quantity))::BIGINT AS c FROM lineitem GROUP BY 1))"
C = "s AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, c FROM (SELECT o_orderdate::DATE AS day, count(*) AS c FROM orders GROUP BY 1))"


def _windows(m: int) -> str:
    return f"""w AS (SELECT i, s0, q0, sqrt(({m} * q0 - s0 * s0)::DOUBLE) AS sd FROM (
  SELECT i, (sum(c) OVER f)::BIGINT AS s0, (sum(c * c) OVER f)::BIGINT AS q0, count(c) OVER f AS n FROM s
  WINDOW f AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)) WHERE n = {m})"""


def _cells(m: int, lags: str) -> str:
    return f"""d AS (SELECT a.i AS i, b.i AS j, (sum(a.c * b.c) OVER (PARTITION BY b.i - a.i ORDER BY a.i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING))::BIGINT AS q
  FROM s a JOIN s b ON {lags}),
r AS (SELECT d.i, d.j, CASE WHEN x.sd = 0 AND y.sd = 0 THEN 1.0::DOUBLE WHEN x.sd = 0 OR y.sd = 0 THEN 0.0::DOUBLE ELSE ({m} * d.q - x.s0 * y.s0)::DOUBLE / (x.sd * y.sd) END AS r
  FROM d JOIN w x ON d.i = x.i JOIN w y ON d.j = y.i)"""


def _dist(m: int, r: str = "r") -> str:
    return f"sqrt(greatest(0.0, {2 * m}::DOUBLE * (1 - {r})))"


BOTH = "u AS (SELECT i AS pos, r, j AS nn FROM r UNION ALL SELECT j, r, i FROM r)"
TOP = "t AS (SELECT pos, max(r) AS r, arg_max(nn, (r, -nn)) AS nn FROM u GROUP BY pos)"


def _profile(source: str, m: int, sides: str = BOTH, dist: str | None = None, digits: int | None = 6) -> str:
    """CTEs up to ``p``: the profile, its distances rounded to ``digits`` if given."""
    dist = dist or _dist(m)
    dist = dist if digits is None else f"round({dist}, {digits})"
    dist = f"CASE WHEN nn IS NOT NULL THEN {dist} END"  # greatest skips nulls
    return f"""WITH {source}, {_windows(m)}, {_cells(m, f"b.i - a.i > {m // 4}")}, {sides}, {TOP},
p AS (SELECT w.i AS pos, {dist} AS dist, nn FROM w LEFT JOIN t ON w.i = t.pos)"""


def _sampled(source: str, m: int, step: int) -> str:
    """CTEs up to ``g``: best match of each sampled window, and ``u``: all cells of the sampled profile."""
    return f"""WITH {source}, {_windows(m)}, {_cells(m, f"b.i - a.i >= {max(1, m // 4)}")}, {BOTH.replace("u AS", "full_u AS")},
f AS (SELECT pos AS i, r, nn AS j FROM full_u WHERE pos % {step} = 0),
g AS (SELECT i, max(r) AS r, arg_max(j, (r, -j)) AS j FROM f GROUP BY i),
k AS (SELECT g.i + o.k AS i, g.j + o.k AS j FROM g, (SELECT unnest(range({1 - step}, {step})) AS k) o WHERE g.i + o.k >= 0 AND g.j + o.k >= 0),
h AS (SELECT k.i, r.r, k.j FROM k JOIN r ON least(k.i, k.j) = r.i AND greatest(k.i, k.j) = r.j),
u AS (SELECT i AS pos, r, j AS nn FROM f UNION ALL SELECT j, r, i FROM f UNION ALL SELECT i, r, j FROM h UNION ALL SELECT j, r, i FROM h), {TOP}"""


def _frames(body: str, source: str = E, m: int = M) -> str:
    return f"WITH {source}, {_windows(m)} {body}"


SHIFTED = f"{E.replace('s AS', 'e AS')}, s AS (SELECT i, c + {OFFSET} AS c FROM e)"
#: A draw of the generator, and of a tile, in SQL.
DRAW = "(('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
SEEDED = lambda text: DRAW.format(f"'{generate.SEED}:' || {text}")
KEPT = DRAW.format(f"'{PART_SEED}:' || i // {PART_TILE} || ':' || j // {PART_TILE}")
COPIES = "(VALUES " + ", ".join(f"({motif}, {copy})" for motif, many in enumerate(WALK_COPIES) for copy in range(many)) + ") v(motif, copy)"
PLACES = f"""g AS (SELECT k, {SEEDED("'gap:' || k")} AS w FROM range({sum(WALK_COPIES) + 1}) t(k)),
b AS (SELECT k, (sum(w) OVER (ORDER BY k)) / (SELECT sum(w ORDER BY k) FROM g) AS part FROM g),
o AS (SELECT motif, row_number() OVER (ORDER BY {SEEDED("'copy:' || motif || ':' || copy")}) - 1 AS k FROM {COPIES}),
x AS (SELECT motif::INTEGER AS motif, (floor({WALK - sum(WALK_COPIES) * WALK_MOTIF} * part)::BIGINT + k * {WALK_MOTIF})::BIGINT AS start, {generate.SCALES[0]}::DOUBLE + {generate.SCALES[1] - generate.SCALES[0]}::DOUBLE * {SEEDED("'scale:' || k")} AS scale FROM o JOIN b USING (k))"""
STEPS = f"""{PLACES}, y AS (SELECT start + u AS pos, motif, u, scale FROM x, range({WALK_MOTIF}) t(u)),
z AS (SELECT p.pos, CASE WHEN motif IS NULL THEN ({SEEDED("'step:' || p.pos")} - 0.5) * {generate.AMPLITUDE}::DOUBLE
  ELSE ({SEEDED("'shape:' || motif || ':' || u")} - 0.5) * {generate.MOTIF_AMPLITUDE}::DOUBLE * scale + ({SEEDED("'noise:' || p.pos")} - 0.5) * {generate.NOISE_AMPLITUDE}::DOUBLE END AS d
  FROM range({WALK}) p(pos) LEFT JOIN y ON p.pos = y.pos)"""
LEFT = "u AS (SELECT j AS pos, r, i AS nn FROM r)"
RIGHT = "u AS (SELECT i AS pos, r, j AS nn FROM r)"
ALL = "SELECT pos, dist, nn FROM p"
_compared = """SELECT count(*) FILTER (WHERE a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.nn IS DISTINCT FROM b.nn) AS n_diff,
round(coalesce(max(abs(a.dist - b.dist)), 0.0), 6) AS max_abs_diff, count(*) FILTER (WHERE b.pos IS NULL) AS n_only_left, count(*) FILTER (WHERE a.pos IS NULL) AS n_only_right"""

ORACLE_SQL = {
    "series_positions": f"WITH {E} SELECT i AS pos, c FROM s",
    "prefix_sums": f"WITH {E} SELECT i AS pos, (sum(c) OVER (ORDER BY i))::BIGINT AS cum, (sum(c * c) OVER (ORDER BY i))::BIGINT AS cum_sq FROM s",
    "window_sums": _frames("SELECT i AS pos, s0, q0 FROM w"),
    "window_mean_std": _frames(f"SELECT i AS pos, s0 / {M * 100}.0::DOUBLE AS mean, sd / {M * 100}.0::DOUBLE AS sd FROM w"),
    "scaled_stats": _frames(f"SELECT i AS pos, round(1 / nullif(sd / {M * 100}.0::DOUBLE, 0), 6) AS inv_sd, round((s0 / {M * 100}.0::DOUBLE) * (1 / nullif(sd / {M * 100}.0::DOUBLE, 0)) * sqrt({M}.0::DOUBLE), 6) AS scaled_mean FROM w"),
    "lag_product": f"WITH {E} SELECT a.i AS pos, a.c * b.c AS product FROM s a JOIN s b ON a.i = b.i + {LAG}",
    "initial_dotproducts": f"WITH {E} SELECT b.i - a.i AS diag, sum(a.c * b.c)::BIGINT AS dot FROM s a JOIN s b ON a.i < {M} AND b.i >= a.i AND b.i - a.i <= (SELECT max(i) FROM s) - {M - 1} GROUP BY 1",
    "diagonal_dotproducts": f"WITH {E} SELECT i, dot FROM (SELECT a.i, (sum(a.c * b.c) OVER f)::BIGINT AS dot, count(*) OVER f AS n FROM s a JOIN s b ON b.i = a.i + {LAG} WINDOW f AS (ORDER BY a.i ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING)) WHERE n = {M}",
    "diagonal_cumulative": f"WITH {E} SELECT i, cum, CASE WHEN n = {M} THEN dot END AS dot FROM (SELECT a.i, (sum(a.c * b.c) OVER (ORDER BY a.i))::BIGINT AS cum, (sum(a.c * b.c) OVER f)::BIGINT AS dot, count(*) OVER f AS n FROM s a JOIN s b ON b.i = a.i + {LAG} WINDOW f AS (ORDER BY a.i ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING))",
    "distance_row": f"""WITH {E}, {_windows(M)}, q AS (SELECT b.i - a.i + {ROW} AS j, sum(a.c * b.c)::BIGINT AS q FROM s a JOIN s b ON a.i BETWEEN {ROW} AND {ROW + M - 1} GROUP BY 1 HAVING count(*) = {M}),
r AS (SELECT j, CASE WHEN x.sd = 0 AND y.sd = 0 THEN 1.0::DOUBLE WHEN x.sd = 0 OR y.sd = 0 THEN 0.0::DOUBLE ELSE ({M} * q - x.s0 * y.s0)::DOUBLE / (x.sd * y.sd) END AS r FROM q JOIN w y ON q.j = y.i JOIN w x ON x.i = {ROW})
SELECT j, round({_dist(M)}, 6) AS dist FROM r WHERE abs(j - {ROW}) >= {max(1, M // 4)}""",
    "dot_from_distance": f"WITH {E} SELECT i, dot FROM (SELECT a.i, (sum(a.c * b.c) OVER f)::BIGINT AS dot, count(*) OVER f AS n FROM s a JOIN s b ON b.i = a.i + {LAG} WINDOW f AS (ORDER BY a.i ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING)) WHERE n = {M}",
    "diagonal_distances": f"WITH {E}, {_windows(M)}, {_cells(M, f'b.i BETWEEN a.i + {LAG} AND a.i + {LAG + 9}')} SELECT i, j, round(greatest(0.0, {2 * M}::DOUBLE * (1 - r)), 6) AS dist2 FROM r",
    "matrix_profile": f"{_profile(E, M)} {ALL}",
    "matrix_profile_shuffle": f"{_profile(E, M)} {ALL}",
    "matrix_profile_squared": f"{_profile(E, M, dist=f'greatest(0.0, {2 * M}::DOUBLE * (1 - r))')} {ALL}",
    "matrix_profile_sql": f"{_profile(Q, M_DAILY)} {ALL}",
    "left_profile": f"{_profile(E, M, LEFT)} {ALL}",
    "right_profile": f"{_profile(E, M, RIGHT)} {ALL}",
    "merge_profiles": f"{_profile(Q, M_DAILY)} {ALL}",
    "sampled_rows": f"{_sampled(E, M, STEP)} SELECT i, round({_dist(M)}, 6) AS dist, j AS nn FROM g",
    "sampled_profile": f"{_sampled(E, M, STEP)} SELECT w.i AS pos, round({_dist(M)}, 6) AS dist, nn FROM w LEFT JOIN t ON w.i = t.pos",
    "refined_profile": f"{_profile(E, M)} {ALL}",
    "daily_quantity_profile": f"{_profile(Q, M_DAILY)} {ALL}",
    "daily_order_counts_profile": f"{_profile(C, M_DAILY)} {ALL}",
    "user_profiles": f"""WITH s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, round(value * 100)::BIGINT AS c FROM events),
w AS (SELECT key, i, s0, q0, sqrt(({M_USER} * q0 - s0 * s0)::DOUBLE) AS sd FROM (SELECT key, i, (sum(c) OVER f)::BIGINT AS s0, (sum(c * c) OVER f)::BIGINT AS q0, count(c) OVER f AS n FROM s
  WINDOW f AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND {M_USER - 1} FOLLOWING)) WHERE n = {M_USER}),
d AS (SELECT a.key, a.i AS i, b.i AS j, (sum(a.c * b.c) OVER (PARTITION BY a.key, b.i - a.i ORDER BY a.i ROWS BETWEEN CURRENT ROW AND {M_USER - 1} FOLLOWING))::BIGINT AS q FROM s a JOIN s b ON a.key = b.key AND b.i - a.i > {M_USER // 4}),
r AS (SELECT d.key, d.i, d.j, CASE WHEN x.sd = 0 AND y.sd = 0 THEN 1.0::DOUBLE WHEN x.sd = 0 OR y.sd = 0 THEN 0.0::DOUBLE ELSE ({M_USER} * d.q - x.s0 * y.s0)::DOUBLE / (x.sd * y.sd) END AS r
  FROM d JOIN w x ON d.key = x.key AND d.i = x.i JOIN w y ON d.key = y.key AND d.j = y.i),
u AS (SELECT key, i AS pos, r, j AS nn FROM r UNION ALL SELECT key, j, r, i FROM r),
t AS (SELECT key, pos, max(r) AS r, arg_max(nn, (r, -nn)) AS nn FROM u GROUP BY key, pos)
SELECT w.key, w.i AS pos, round({_dist(M_USER)}, 6) AS dist, nn FROM w LEFT JOIN t ON w.key = t.key AND w.i = t.pos""",
    "compare_profiles": f"""SELECT * FROM (WITH x AS ({_profile(Q, M_DAILY, digits=None)} {ALL}),
y AS ({_sampled(Q, M_DAILY, 7)} SELECT w.i AS pos, {_dist(M_DAILY)} AS dist, nn FROM w LEFT JOIN t ON w.i = t.pos)
{_compared} FROM x a FULL JOIN y b ON a.pos = b.pos)""",
    "validate_summary": f"WITH {Q}, {_windows(M_DAILY)} SELECT algo, (SELECT count(*) FROM w) AS n_positions, 0::BIGINT AS n_diff, 0.0::DOUBLE AS max_abs_diff FROM (VALUES ('broadcast'), ('shuffle')) v(algo)",
    "top_motifs": f"{_profile(Q, M_DAILY, digits=None)} SELECT pos, round(dist, 6) AS dist, nn FROM (SELECT * FROM p WHERE dist IS NOT NULL ORDER BY p.dist, pos LIMIT 10)",
    "top_discords": f"{_profile(Q, M_DAILY, digits=None)} SELECT pos, round(dist, 6) AS dist, nn FROM (SELECT * FROM p WHERE dist IS NOT NULL ORDER BY p.dist DESC, pos LIMIT 10)",
    "split_work": "SELECT id AS part, id * (9937 // 7) + least(id, 9937 % 7) AS first, (id + 1) * (9937 // 7) + least(id + 1, 9937 % 7) - 1 AS last, (9937 // 7) + (id < 9937 % 7)::BIGINT AS size FROM range(7) t(id)",
    "balanced_pairs": "SELECT CASE WHEN id < 6 THEN id ELSE 11 - id END AS rank, id AS part, id * (9920 // 12) + least(id, 9920 % 12) AS first, (id + 1) * (9920 // 12) + least(id + 1, 9920 % 12) - 1 AS last, (9920 // 12) + (id < 9920 % 12)::BIGINT AS size FROM range(12) t(id)",
    "diagonal_blocks": "SELECT id AS block, id * 500 AS first, least((id + 1) * 500, 9920) - 1 AS last FROM range(20) t(id)",
    "triangle_tiles": "SELECT id AS rank, floor(sqrt(id))::BIGINT AS row, (id - floor(sqrt(id))::BIGINT ** 2)::BIGINT // 2 AS col, (floor(sqrt(id))::BIGINT % 2 = 0) = (id % 2 = 1) AS is_upper FROM range(81) t(id)",
    "tile_ranks": "WITH t AS (SELECT id AS rank, floor(sqrt(id))::BIGINT AS row, (id - floor(sqrt(id))::BIGINT ** 2)::BIGINT // 2 AS col FROM range(81) t(id)) SELECT 'row' AS kind, row AS line, count(*) AS n, min(rank) AS first_rank, max(rank) FILTER (WHERE row = col) AS reader FROM t GROUP BY row UNION ALL SELECT 'column', col, count(*), min(rank), max(rank) FILTER (WHERE row = col) FROM t GROUP BY col",
    "tile_geometry": f"WITH n AS (SELECT count(*) AS n FROM events), p AS (SELECT n, n - {M + M // 4} AS work, CASE WHEN (n - {M + M // 4}) % 7 = 0 THEN 0 ELSE 7 - (n - {M + M // 4}) % 7 END::BIGINT AS pad FROM n) SELECT n, work, pad, (n + pad - {M + M // 4}) // 7 AS tile_length FROM p",
    "ascii_roundtrip": f"WITH {E} SELECT i AS pos, c / 100.0::DOUBLE AS value FROM s",
    "bin_roundtrip": f"WITH {E} SELECT i AS pos, c / 100.0::DOUBLE AS value FROM s",
    "profile_roundtrip": f"{_profile(Q, M_DAILY)} {ALL}",
}
ORACLE_SQL["similarity_search"] = ORACLE_SQL["distance_row"].replace("SELECT j, round(", "SELECT j AS pos, round(")
ORACLE_SQL["shifted_profile"] = ORACLE_SQL["shifted_profile_shuffle"] = f"{_profile(SHIFTED, M_USER)} {ALL}"
ORACLE_SQL["shifted_search"] = f"""WITH {SHIFTED}, {_windows(M_USER)}, q AS (SELECT b.i - a.i + {ROW} AS j, sum(a.c * b.c)::BIGINT AS q FROM s a JOIN s b ON a.i BETWEEN {ROW} AND {ROW + M_USER - 1} GROUP BY 1 HAVING count(*) = {M_USER}),
r AS (SELECT j, CASE WHEN x.sd = 0 AND y.sd = 0 THEN 1.0::DOUBLE WHEN x.sd = 0 OR y.sd = 0 THEN 0.0::DOUBLE ELSE ({M_USER} * q - x.s0 * y.s0)::DOUBLE / (x.sd * y.sd) END AS r FROM q JOIN w y ON q.j = y.i JOIN w x ON x.i = {ROW})
SELECT j AS pos, round({_dist(M_USER)}, 6) AS dist FROM r WHERE abs(j - {ROW}) >= {max(1, M_USER // 4)}"""
for name in ("doubles_profile_sql", "doubles_profile_broadcast", "doubles_profile_shuffle", "table_function_profile", "streamed_profile", "chunked_profile", "profile_converted"):
    ORACLE_SQL[name] = f"{_profile(Q, M_DAILY)} {ALL}"
ORACLE_SQL |= {
    "timestamp_positions": "SELECT row_number() OVER (ORDER BY ts) - 1 AS pos, round(value * 100)::BIGINT AS c FROM events",
    "sampled_profile_shuffle": ORACLE_SQL["sampled_profile"],
    "sampled_rows_shuffle": ORACLE_SQL["sampled_rows"],
    "user_profiles_by_blocks": ORACLE_SQL["user_profiles"],
    "score_forms": f"""WITH {E}, {_windows(M)}, t AS (SELECT i, mean, sd, 1 / sd AS inv, mean * (1 / sd) * sqrt({M}.0::DOUBLE) AS sm FROM (SELECT i, s0 / {M * 100}.0::DOUBLE AS mean, sd / {M * 100}.0::DOUBLE AS sd FROM w)),
d AS (SELECT i, dot / 10000.0::DOUBLE AS dot FROM (SELECT a.i, (sum(a.c * b.c) OVER f)::BIGINT AS dot, count(*) OVER f AS n FROM s a JOIN s b ON b.i = a.i + {LAG} WINDOW f AS (ORDER BY a.i ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING)) WHERE n = {M}),
c AS (SELECT d.i, dot * (x.inv * y.inv) - x.sm * y.sm AS score, 2 * ({M}.0::DOUBLE - (dot - {M}.0::DOUBLE * x.mean * y.mean) / (x.sd * y.sd)) AS direct FROM d JOIN t x ON d.i = x.i JOIN t y ON d.i + {LAG} = y.i)
SELECT i, round(score, 6) AS score, round({2 * M}.0::DOUBLE - 2 * score, 6) AS dist2, round(direct, 6) AS direct FROM c""",
    "early_profile": f"""WITH {E}, {_windows(M)}, {_cells(M, f"b.i - a.i > {M // 4}").replace("r AS (", "every AS (")}, r AS (SELECT * FROM every WHERE {KEPT} < {PART}::DOUBLE), {BOTH}, {TOP},
p AS (SELECT w.i AS pos, round({_dist(M)}, 6) AS dist, nn FROM w LEFT JOIN t ON w.i = t.pos) {ALL}""",
    "profile_counters": f"WITH {Q}, {_windows(M_DAILY)}, n AS (SELECT count(*) AS p FROM w) SELECT p AS positions, p AS partners, ((p - {M_DAILY // 4 + 1}) * (p - {M_DAILY // 4}) // 2)::BIGINT AS cells, true AS all_updated FROM n",
    "series_slice": f"WITH {E}, f AS (SELECT least(1000, count(*) - 500) AS f FROM s) SELECT i AS pos, c / 100.0::DOUBLE AS value FROM s, f WHERE i >= f AND i < f + 500",
    "series_length": "SELECT format, (SELECT count(*) FROM events) AS n FROM (VALUES ('ascii'), ('bin')) v(format)",
    "series_converted": ORACLE_SQL["ascii_roundtrip"],
    "paired_runs": """WITH f AS (SELECT n_regionkey || '_l100m8' AS config, CASE WHEN n_regionkey < 3 AND n_nationkey % 3 = 1 THEN 'sequential' WHEN n_regionkey < 3 AND n_nationkey % 3 = 2 THEN 'blocks' ELSE 'tiles' END AS algo, n_regionkey, n_nationkey FROM nation),
g AS (SELECT config, algo, n_nationkey::VARCHAR AS procs, 'matprof_v' || n_regionkey || '_l100m8_alg#' || algo || '#_p' || n_nationkey || '_x.bin' AS other FROM f),
h AS (SELECT *, min(other) FILTER (WHERE algo = 'sequential') OVER (PARTITION BY config) AS base, lag(other) OVER (PARTITION BY config ORDER BY other) AS prior FROM g)
SELECT config, coalesce(base, prior) AS baseline, other, algo, procs, base IS NOT NULL AS by_baseline FROM h WHERE coalesce(base, prior) <> other""",
    "folder_validation": f"SELECT 3::BIGINT AS files, 1::BIGINT AS configs, 'blocks,sequential,tiles' AS algorithms, '1,4,8' AS process_counts, '2500' AS lengths, '{M_DAILY}' AS windows, 2::BIGINT AS pairs, 0::BIGINT AS differences, 0.0::DOUBLE AS max_abs_diff",
    "next_counts": """WITH a AS (SELECT mode, base::INTEGER AS base, current::INTEGER AS current FROM (VALUES ('linear'), ('square'), ('exp'), ('square_exp')) m(mode), (VALUES (2), (3)) b(base), range(1, 41) c(current)),
p AS (SELECT *, (SELECT min(pow(a.base, k)::BIGINT) FROM range(1, 9) t(k) WHERE pow(a.base, k) > a.current) AS power FROM a)
SELECT mode, base, current, CASE mode WHEN 'linear' THEN current + base WHEN 'square' THEN (floor(sqrt(current)) + 1) ** 2 WHEN 'exp' THEN power
  ELSE CASE WHEN floor(sqrt(power)) ** 2 > current AND floor(sqrt(power)) ** 2 < 20 THEN floor(sqrt(power)) ** 2 ELSE (floor(sqrt(power)) + 1) ** 2 END END::BIGINT AS next FROM p""",
    "planted_places": f"WITH {PLACES} SELECT motif, start, round(scale, 6) AS scale FROM x",
    "random_embeddings": f"""WITH s AS (SELECT s::INTEGER AS seed, 2 + floor({DRAW.format("s || ':many'")} * {WALK // (2 * WALK_MOTIF) - 1})::BIGINT AS many FROM range(100) t(s)),
c AS (SELECT seed, 0 AS cut FROM s UNION ALL SELECT seed, k FROM s, range(1, {WALK // (2 * WALK_MOTIF) + 2}) t(k) WHERE k < many AND {DRAW.format("seed || ':cut:' || k")} < {generate.ANOTHER}::DOUBLE)
SELECT seed, (row_number() OVER (PARTITION BY seed ORDER BY cut) - 1)::INTEGER AS motif, (lead(cut, 1, many) OVER (PARTITION BY seed ORDER BY cut) - cut)::INTEGER AS many FROM c JOIN s USING (seed)""",
    "generated_walk": f"WITH {STEPS} SELECT pos, round(sum(d) OVER (ORDER BY pos), 3) AS value FROM z",
    "generated_noise": f"WITH {STEPS} SELECT pos, round(d, 6) AS value FROM z",
}
