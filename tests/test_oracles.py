"""Every query of the library's own operators that SQL can express gives DuckDB's rows."""

import duckdb
import pytest

from quillmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "events", "pages", "labels", "benchmark")


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = list(got.columns)
    got, want = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)


def test_every_sql_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
