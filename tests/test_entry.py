from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from lexigrid.plans import corpus_queries, layer_queries, tagging_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = df.toPandas(), con.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(map(str, f[cols].fillna("null").astype(str).values.tolist())) for f in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(corpus_queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    same_rows(corpus_queries.QUERIES[name](spark, sf), corpus_queries.ORACLE[name], sf)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(corpus_queries.QUERIES) - set(corpus_queries.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert corpus_queries.QUERIES[name](spark, sf).count() > 0
