"""The corpus queries that SQL can express, against DuckDB on a bundled table."""

import duckdb
import pytest
from corpus_cases import SF01

from tabscope.llm import queries


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    rel = con.sql(queries.oracle_sql()[key])
    df = queries.queries()[key](spark, SF01)
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    exp = sorted(map(tuple, rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == exp
