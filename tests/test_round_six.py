"""Findings of the fourth round, each by a case that took too much disk or gave other rows than its SQL before."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexigrid.operators import gating as G

KEYS = ["source", "sentence_id", "pos"]


@pytest.mark.parametrize(("threshold", "group"), [(1.0, None), (0.4, "type"), (0.0, None)])
def test_predictions_in_columns_are_gated_as_in_tables(spark, threshold, group):
    """The same metrics and shares as by joins, also for null labels, placeholders and sentences without a source."""
    data = [(None if k % 11 == 0 else f"s{k % 2}", k % 5, k, f"W{k % 7}", f"t{k % 3}", None if k % 17 == 0 else "none" if k % 6 == 0 else f"l{k % 3}", f"l{k % 4}", None if k % 13 == 0 else f"l{k % 3}") for k in range(90)]
    rows = spark.createDataFrame(data, "source string, sentence_id int, pos int, word string, type string, true_label string, base string, expert string")
    words = spark.createDataFrame([("w1",), ("W4",), ("w4",)], "word string")
    tables = [rows.select(*KEYS, F.col(c).alias("label"), F.lit(0.5).alias("probability")) for c in ("base", "expert")]
    want = G.gated_evaluate(rows, *tables, words, threshold, KEYS, group=group)
    got = G.gated_evaluate(rows, "base", "expert", words, threshold, KEYS, group=group)
    for a, b in zip(want, got, strict=True):
        assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_gated_evaluation_moves_no_words(spark, sf, tmp_path):
    """Documents of one source and id, which a join of words by place multiplies, are counted as by SQL; words are not shuffled."""
    rows = [(1, "a b c d e f g h", "en", "x"), (1, "a bb ccc a bb", "en", "x"), (2, "dd e ff", "en", None), (3, "gg h", "de", "y"), (4, None, "de", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "bb A")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    query = entry.queries()["gated_evaluation"]
    assert [tuple(r) for r in query(spark, str(tmp_path)).collect()] == db.execute(entry.oracle_sql()["gated_evaluation"]).fetchall()
    plan = query(spark, sf)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 1 and "ResolvedHint (strategy=broadcast)" in plan
