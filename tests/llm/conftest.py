from __future__ import annotations

import pytest

LONG = ("lorem ipsum dolor sit amet " * 8000).strip()
#: id, text, lang, source, n_chars; nulls in every column, empty, blank, long, repeated and tied rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b", 69),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b", 69),
    (3, None, "en", "a", None),
    (4, "", None, "a", 0),
    (5, " \t\n ", "fr", None, 4),
    (6, LONG, "la", "a", len(LONG)),
    (7, "Write to ann@example.com or call +1 (212) 555-0100, card 4111 1111 1111 1111, host 10.0.0.1", "en", "a", None),
    (8, "1234 5678 !!! ???", "en", "a", 17),
    (None, "un texte sans identifiant mais avec assez de mots pour compter", "fr", "a", 60),
    (None, None, None, None, None),
    (9, "Licensed under the MIT Licence.\nzwei Zeilen ▁ mit Zeichen \U0001f600 und\ttab", "de", "a", 66),
    (-5, "x", "en", "a", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their own columns.
CLASHES = "score fp shard slot size digest w h n key part pieces own least component_id candidate held_out lang_pred spans found html id sequence __id __all bucket mask pattern text_crc32 item_id y".split()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)
