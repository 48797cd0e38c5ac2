"""The corpus pipeline: five stages from raw documents to pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's result as Parquet to the shared folder, reads it again as
the next one's documents, and deletes what the stage wrote besides. The first
four keep the columns of ``documents``, with any others that there are (also
ones named like columns that the operators make for themselves).

Rows: an empty table passes through as an empty table. A row with a null or
empty text goes at the first stage, as does one without a letter; from then on
there is none, but each stage by itself takes them (the first column says how).

| Stage | Null or empty text | Null id | Repeated rows and ties | Very long text |
|---|---|---|---|---|
| language_id | goes | judged like any | judged one by one, all alike | judged whole, in pieces |
| simhash_near_dedup | fingerprint zero: one group | stays, takes no part | least id stays; of rows with that id the one with the least text, then the least as JSON | one fingerprint of the whole |
| benchmark_decontamination | stays | an id of its own: rows without id go together | rows of one id go together | searched whole |
| pii | stays as it is | redacted like any | redacted one by one, all alike | scanned whole |
| sentencepiece | no pieces | encoded like any | equal texts, equal pieces | encoded whole, in pieces |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifgrid.llm import decontamination, langid, piece_codec, pii, simhash_dedup
from motifgrid.llm.common import discard, materialize, passing, read_table
from motifgrid.llm.queries import PIECE_MODEL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language the model doesn't identify, or whose n-grams aren't those of the learned ones."""
    return langid.accepted(docs, langid.fit(langid.learnable(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id."""
    return simhash_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind."""
    return pii.redact_pii(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as pieces, checked by decoding."""
    return piece_codec.encode_rows(docs, PIECE_MODEL)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("sentencepiece", pieces),
]

#: Trained weights, components and merges aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with passing() as kept:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        discard(before)  # does nothing to the documents table itself
    return docs
