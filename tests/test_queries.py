"""Every registered query of the core against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from paperloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    return list(value) if hasattr(value, "tolist") else value


def rows(frame):
    names = sorted(frame.columns)
    return sorted((tuple(str(plain(v)) for v in r) for r in frame[names].itertuples(index=False)))


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got) == rows(want)


def test_entry_works_without_the_optional_parts():
    """The core imports nothing of the training-data operators."""
    import subprocess
    import sys

    code = "import sys; sys.modules['paperloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]
