"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries as event_queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).columns == ["dim", "events", "revenue"]


def _plain(v):
    return f"{float(v):.4f}" if hasattr(v, "as_tuple") or isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [q for q in event_queries.queries() if q in event_queries.oracle_sql()])
def test_oracle(spark, duck, sf, name):
    df = event_queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted("|".join(_plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(event_queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    expected = sorted("|".join(_plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert sorted(names) == columns and got == expected


def test_llm_is_optional():
    names = set(entry.queries())
    assert set(event_queries.queries()) <= names
    if entry.HAS_PIPELINE:
        assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
