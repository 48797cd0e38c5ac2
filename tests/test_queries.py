"""Every registered query of the engine against its SQL, and the entry file without the optional parts."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from motifgrid import queries
from tests.conftest import SF

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, against_duck):
    against_duck(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_query_without_sql_gives_rows(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["pos", "dist", "nn"] and df.count() == 1000 - queries.M + 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_optional_parts():
    """The entry file works when the subpackage and the pipeline are gone."""
    code = "import sys; sys.modules['motifgrid.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'matrix_profile' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_without_a_library_says_so():
    """A missing library isn't taken for missing folders."""
    if not (ROOT / "motifgrid" / "llm").exists():
        pytest.skip("the optional parts are gone")
    code = "import sys; sys.modules['xxhash'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    assert e.name == 'xxhash', e.name\nelse:\n    raise SystemExit('not noticed')"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
