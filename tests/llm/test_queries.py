"""The registered queries that have SQL, against DuckDB."""

import duckdb
import pytest

from larkspur.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cursor = c.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in cursor.description)
    assert sorted(df.columns) == columns
    names = [d[0] for d in cursor.description]
    assert sorted(map(str, df.select(*names).toPandas().itertuples(index=False, name=None))) == sorted(map(str, cursor.fetchall()))


def test_every_operator_has_a_query():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13
