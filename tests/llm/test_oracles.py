"""The queries against their oracle SQL."""

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


def _plain(v):
    return f"{float(v):.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    expected = sorted("|".join(_plain(v) for _, v in sorted(zip(names, r))) for r in found.fetchall())
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted("|".join(_plain(r[c]) for c in sorted(names)) for r in df.collect()) == expected
