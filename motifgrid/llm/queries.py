"""The registered queries of the training-data operators: thin digests over whole tables.

``QUERIES`` maps a name to ``f(spark, sf_dir)``; ``ORACLE_SQL`` has DuckDB SQL
where SQL can express the result over whole tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extract, langid, license_scan, media_columns, piece_codec, pii, quality_cnn, sharding, simhash_dedup
from .common import id_remainder, read_table

#: The tokenizer file, the same path on every machine.
PIECE_MODEL = os.environ.get("MOTIFGRID_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(langid.learnable(docs), key=F.col("doc_id"))
    held = id_remainder("doc_id") == 2
    found = langid.identify(docs.withColumn("__id", F.struct("doc_id", held.alias("held_out"))), model, "__id")
    return found.select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = license_scan.known_digests(spark)
    return license_scan.scan(read_table(spark, sf_dir, "documents"), F.broadcast(known))  # a constant table


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_codec.encode_rows(read_table(spark, sf_dir, "documents"), PIECE_MODEL)
    return found.select("doc_id", F.size("pieces").alias("n_pieces"), "n_bytes", "decoded_sha256", "lossless", "pieces")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = quality_cnn.fit(docs, read_table(spark, sf_dir, "labels"), learn=id_remainder("doc_id") != 2)
    found = quality_cnn.score(docs.withColumn("__id", F.struct("doc_id", (id_remainder("doc_id") == 2).alias("held_out"))), net, "__id")
    return found.select("doc_id.doc_id", "doc_id.held_out", "score", (F.col("score") >= quality_cnn.CUT).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns.document_media(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_blocks", "blocks_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.placed(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_piece_codec": op3_piece_codec,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_html_extract": op7_html_extract,
    "op8_media_columns": op8_media_columns,
    "op9_sharding": op9_sharding,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle(),
    "op6_decontamination": decontamination.ORACLE,
    "op9_sharding": sharding.ORACLE,
}
