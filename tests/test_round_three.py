"""Findings of the third round, each by a case that gave an error, a loss or too much work before."""

from __future__ import annotations

from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexigrid.operators import differences as DI
from lexigrid.operators import gating as G
from lexigrid.operators import sequences as Q


def test_task_export_of_odd_first_words_repeated_texts_and_nulls(spark, tmp_path):
    rows = [(1, "erßie  two"), (2, "same text"), (3, "same text"), (4, None), (5, "ﬁne ŉot")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, entry.queries()["label_task_export"](spark, str(tmp_path)).collect()))
    assert got == [(1, "erßie", 0, 5), (2, "same", 0, 4), (3, "same", 0, 4), (4, "", 0, 0), (5, "ﬁne", 0, 3)]


def test_found_rows_are_handed_on_in_parts(spark):
    """A batch of texts gives far more rows than it has; no part of them is larger than the bound, and none is lost."""
    def load():
        return lambda i, n: ((i, k) for k in range(n))

    parts = []
    batches = [pa.RecordBatch.from_pydict({"i": [1, 2, 3], "n": [40_000, 0, 5]})]
    plan = type("Frame", (), {"mapInArrow": lambda self, run, ddl: parts.extend(run(iter(batches)))})()
    Q.map_rows(plan, "i long, k long", load)
    assert max(p.num_rows for p in parts) <= Q.FOUND_ROWS
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == [(i, k) for i, n in ((1, 40_000), (3, 5)) for k in range(n)]


def test_items_left_out_need_no_table(monkeypatch):
    monkeypatch.setattr(DI, "_lengths", lambda *_: pytest.fail("rows of lengths for items left out"))
    a = np.arange(20_000) % 97
    b = a[a % 7 != 3]
    for x, y in ((a, b), (b, a)):
        found = DI.differences(x, y)
        assert sum(j - i for i, j, _, _ in found) + sum(m - k for _, _, k, m in found) == len(a) - len(b)


def test_gated_evaluation_joins_each_table_once(spark):
    rows = spark.createDataFrame([("s", 1, k, w, t) for k, (w, t) in enumerate([("a", "x"), ("b", "y"), ("c", "none"), ("d", "y")])], "source string, sentence_id long, pos long, word string, true_label string")
    keys = ["source", "sentence_id", "pos"]
    base, expert = (rows.select(*keys, F.lit(v).alias("label"), F.lit(0.5).alias("probability")) for v in "xy")
    scored, shares = G.gated_evaluate(rows, base, expert, spark.createDataFrame([("b",)], "word string"), 1.0, keys)
    assert scored._jdf.queryExecution().analyzed().toString().count("Join") == 5  # the list for rows and densities, densities, two scorers; nine before
    assert scored.select("rows", "accuracy").first() == (3, round(2 / 3, 6))
    assert dict(shares.collect()) == {"baseline": 2, "expert": 1, "placeholder": 1}
