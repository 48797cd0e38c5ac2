"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a score for a key, ``-weight / ln(u)`` with ``u`` in (0, 1)
from a hash of key and shard number; the largest score wins. So the key and the
shard list decide alone, the shares follow the weights, and one more shard
takes rows only into itself. All of it is column expressions: one pass over
the texts, then shuffles of the short rows (id, size, checksum) only.

Slots number the rows of a shard without gaps and without ever bringing a
shard to one task: rows fall into hash buckets of about ``BUCKET_ROWS``, bucket
counts give each bucket its first slot, and rows are numbered inside their
bucket. A bucket hashes id, size and checksum, so one id with many texts (or
the null id) is spread over all buckets. Rows that agree in id and text are
counted before any shuffle and numbered again from the count, so a row repeated
without end is one row on the wire.

Edge cases: a null text has size 1 and checksum 0 (that of no bytes); a null id
is the key of no characters; repeated rows share the shard and get slots of
their own; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SHARDS = 16
#: Rows of a numbering bucket, about.
BUCKET_ROWS = 2048
#: Copies of a repeated row that one array holds.
RUN = 1 << 16


def _fraction(key: Column, salt: str) -> Column:
    """52 bits of a digest of key and salt, as a number inside (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def score(key: Column, shard: int, weight: float) -> Column:
    return F.lit(-float(weight)) / F.log(_fraction(key, str(shard)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard's number, 0 to ``len(weights) - 1``."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    scores = F.array(*[score(key, k, w) for k, w in enumerate(weights)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def assign(df: DataFrame, key_col: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; narrow. ``out`` replaces a column of that name."""
    return df.withColumn(out, rendezvous(_key(key_col), weights))


def _key(key_col: str) -> Column:
    return F.coalesce(F.col(key_col).cast("string"), F.lit(""))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, extra: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` for every row.

    ``grown_shard`` is the shard after one more of weight ``extra`` joins.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    read = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    once = materialize(read.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "placed")
    rows = once.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-rows // (bucket_rows * len(weights))))
    # the scores are arrays of their own columns, so they are computed once each
    scored = once.select("*", F.array(*[score(_key("doc_id"), k, w) for k, w in enumerate([*weights, extra])]).alias("__all"))
    scored = scored.withColumn("__own", F.slice("__all", 1, len(weights)))
    put = scored.select(
        "doc_id", "size", "text_crc32", "n",
        (F.array_position("__own", F.array_max("__own")) - 1).cast("int").alias("shard"),
        (F.array_position("__all", F.array_max("__all")) - 1).cast("int").alias("grown_shard"),
        F.floor(_fraction(F.concat_ws(":", _key("doc_id"), "size", "text_crc32"), "bucket") * buckets).cast("int").alias("bucket"),
    )
    put = materialize(put, "placed")
    discard(once)
    first = put.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    put = put.withColumn("__at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(first, ["shard", "bucket"])
    runs = put.withColumn("__run", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {RUN}"))))
    copies = runs.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(RUN - 1).cast("bigint"), F.col("n") - 1 - F.col("__run") * RUN))))
    return copies.select("doc_id", "size", "text_crc32", "shard", (F.col("__first") + F.col("__at") + F.col("__run") * RUN + F.col("__copy")).cast("bigint").alias("slot"), "grown_shard")


#: The same over ``documents`` with equal weights, as DuckDB SQL; the checksum runs byte by byte over its table.
ORACLE = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::UBIGINT AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, key, n, list_prepend(4294967295::UBIGINT, list_transform(range(n), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::UBIGINT)) AS l FROM d),
c AS (SELECT doc_id, key, (n + 1)::BIGINT AS size, xor(list_reduce(l, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM x, tab),
s AS (SELECT key, s, ('0x' || substr(md5(key || ':' || s), 1, 13))::BIGINT AS h FROM (SELECT DISTINCT key FROM c), range({SHARDS + 1}) r(s)),
w AS (SELECT key, (arg_max(s, (h, -s)) FILTER (WHERE s < {SHARDS}))::INTEGER AS shard, arg_max(s, (h, -s))::INTEGER AS grown_shard FROM s GROUP BY key),
b AS (SELECT greatest(1, ceil(count(*) / {BUCKET_ROWS * SHARDS}.0)) AS buckets FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard
  ORDER BY floor((('0x' || substr(md5(key || ':' || size || ':' || text_crc32 || ':bucket'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 * buckets), doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM c JOIN w USING (key), b
"""
