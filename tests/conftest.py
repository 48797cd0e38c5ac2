from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(rows, names):
    """Rows as comparable text, columns by name."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: "null" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted([tuple(show(r[k]) for k in order) for r in rows])


@pytest.fixture(scope="session")
def against_duck(spark, duck):
    def check(query, sql, sf_dir=SF):
        df = query(spark, sf_dir)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        assert canon([tuple(r) for r in df.collect()], df.columns) == canon(found.fetchall(), names)

    return check
