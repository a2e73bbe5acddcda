from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import differences as DI
from lexigrid.operators import gating as G
from lexigrid.operators import metrics as M
from lexigrid.operators import sequences as Q
from lexigrid.operators import spans as P
from lexigrid.sources import incremental as I
from lexigrid.sources import readers as R
from lexigrid.sources import sinks as K


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_differences_leave_a_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(1500):
        k = r.randint(1, 5)
        a, b = ([r.randint(0, k) for _ in range(r.randint(0, 14))] for _ in range(2))
        if r.random() < 0.5:
            b = [x for x in a if r.random() < 0.8]
        places = DI.differences(np.array(a, np.int64), np.array(b, np.int64))
        x = y = same = 0
        for i, j, k, m in [*places, (len(a), len(a), len(b), len(b))]:
            assert a[x:i] == b[y:k] and (j > i or m > k or (i, k) == (len(a), len(b)))
            same += i - x
            x, y = j, m
        assert same == longest_common(a, b)


@pytest.mark.parametrize("edits", [1, 2, 5])
def test_differences_with_few_edits_allowed_for_at_first(monkeypatch, edits):
    monkeypatch.setattr(DI, "EDITS", edits)
    test_differences_leave_a_longest_common_subsequence()


def test_differences_of_long_sequences():
    a = np.arange(100_000) % 977
    b = np.delete(a, [5, 70_000])
    assert DI.differences(a, b) == [(5, 6, 5, 5), (70_000, 70_001, 69_999, 69_999)]
    assert DI.differences(np.arange(3_000), np.arange(3_000) + 3_000) == [(0, 3_000, 0, 3_000)]


def test_sequence_differences_of_rows(spark):
    rows = [(1, [1, 2, 3], [1, 3]), (1, None, None), (2, [], [4]), (3, [None, 1], [None, 1]), (None, [7], [8])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, a array<int>, b array<int>, places string")
    got = sorted(((r["id"], r["n_a"], r["n_b"], r["first"], r["mismatches"], r["same"], [tuple(p) for p in r["places"]]) for r in DI.sequence_differences(df, ["id"], "a", "b").collect()), key=repr)
    assert got == sorted([(1, 3, 2, 1, 2, 2, [(1, 2, 1, 1)]), (1, 0, 0, None, 0, 0, []), (2, 0, 1, 0, 1, 0, [(0, 0, 0, 1)]), (3, 2, 2, None, 0, 2, []), (None, 1, 1, 0, 1, 0, [(0, 1, 0, 1)])], key=repr)
    assert DI.sequence_differences(df.limit(0), ["id"], "a", "b").count() == 0


def test_files_are_taken_once_and_bad_rows_are_kept(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: I.process_new_files(spark, source, "id long, text string", lambda d: d.withColumn("n", F.length("text")), F.when(F.col("text").isNull(), "no text"), target, state)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "text": "abc"}\n{"id": 2}\nno object\n')
    assert run() == {"rows": 3, "errors": 2} and run() == {"rows": 0, "errors": 0}
    (tmp_path / "in" / "b.json").write_text('{"id": 3, "text": "de"}\n')
    assert run() == {"rows": 1, "errors": 0}
    good, bad = I.processed(spark, target)
    assert {(r["id"], r["n"]) for r in good.collect()} == {(1, 3), (3, 2)}
    assert sorted((str(r["id"]), r["error"]) for r in bad.collect()) == [("2", "no text"), ("None", "no text")]


def test_existing_annotations(spark, tmp_path):
    path = str(tmp_path / "layers")

    def scorer(frames):
        for f in frames:
            n = f["text"].str.len().fillna(0).astype(int)
            yield pd.DataFrame({"id": f["id"], "n_words": n, "n_labels": n, "version": f["version"]})

    schema = "id long, n_words int, n_labels int, version int"
    docs = lambda ids, v: spark.createDataFrame([(i, None if i == 2 else "ab", v) for i in ids], "id long, text string, version int")
    error = F.when(F.col("n_words") == 0, "empty")
    read = lambda: {(r["id"], r["version"]) for r in spark.read.schema(f"{schema}, error string").json(path).collect()}
    assert K.reannotate(docs([1, 2], 1), scorer, schema, path, "id", "skip", error=error) == {"rows": 2, "errors": 1}
    assert K.reannotate(docs([1, 2, 3], 2), scorer, schema, path, "id", "skip", error=error) == {"rows": 1, "errors": 0}
    assert read() == {(1, 1), (2, 1), (3, 2)}
    assert K.reannotate(docs([1], 3), scorer, schema, path) == {"rows": 1, "errors": 0} and read() == {(1, 3)}
    with pytest.raises(FileExistsError):
        K.reannotate(docs([1], 3), scorer, schema, path, existing="fail")
    with pytest.raises(ValueError):
        K.reannotate(docs([1], 3), scorer, schema, path, existing="other")

    def uneven(frames):
        for f in scorer(frames):
            yield f.assign(n_labels=f["n_words"] + 1)

    with pytest.raises(Exception, match="differ in length"):
        K.reannotate(docs([1], 3), uneven, schema, path)


def test_two_metrics_of_ones_own(spark):
    rows = [("g", "a", "a"), ("g", "a", "b"), ("h", "b", "b"), ("h", None, "b"), (None, "a", "a"), ("h", None, None)] * 50
    df = spark.createDataFrame(rows, "g string, true_label string, pred_label string").repartition(5)
    hits = M.Metric("hits", {"right": "long", "n": "long"}, lambda t, p: (int((t == p).sum()), len(t)), F.col("right") / F.col("n"))
    lengths = M.Metric("length_gap", {"gap": "double", "n": "long"}, lambda t, p: (float(sum(abs(len(a) - len(b)) for a, b in zip(t, p, strict=True))), len(t)), F.col("gap") / F.col("n"))
    assert tuple(M.evaluate_with(df, [hits, lengths]).first()) == (200 / 300, 0.0)
    got = {r["grp"]: (r["hits"], r["length_gap"]) for r in M.evaluate_with(df, [hits, lengths], group="g").collect()}
    assert got == {"g": (0.5, 0.0), "h": (2 / 3, 0.0)}
    assert M.evaluate_with(df.limit(0), [hits]).first()["hits"] is None
    with pytest.raises(ValueError):
        M.evaluate_with(df, [hits, hits])


def test_two_decorators_of_words(spark):
    df = spark.createDataFrame([(1, 0, "▁ab", "x"), (1, 1, "cd", "y"), (2, 2, "▁e", "z")], "w int, sub int, piece string, labels string")
    got = {r["w"]: (r["labels"], r["pieces"]) for r in Q.first_subtoken(df, ["w"]).collect()}
    assert got == {1: ("x", ["ab", "cd"]), 2: ("z", ["e"])}
    last = lambda parts: {"labels": F.element_at(parts, -1)["labels"], "n": F.size(parts)}
    assert {r["w"]: (r["labels"], r["n"]) for r in Q.first_subtoken(df, ["w"], decorator=last).collect()} == {1: ("y", 2), 2: ("z", 1)}
    every = lambda parts: {"labels": F.array_join(F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["labels"]))), "|")}
    assert {r["w"]: r["labels"] for r in Q.first_subtoken(df, ["w"], decorator=every).collect()} == {1: "x|y", 2: "z"}


def test_phrases_break_at_sentences_and_join_several_labels(spark):
    tags = [(0, 0, ["B-a"]), (1, 0, ["I-a"]), (2, 1, ["I-a"]), (3, 1, ["I-a", "O"]), (4, 1, ["I-b", "I-a"]), (5, 1, ["O"]), (6, 1, ["I-b", "B-c"]), (7, 1, None), (8, 1, []), (9, 2, ["I-b"])]
    df = spark.createDataFrame([(1, *x, f"w{x[0]}") for x in tags], "doc int, pos int, s int, tag array<string>, word string")
    spans = lambda d: [(r["start"], r["end"], r["type"]) for r in d.orderBy("start").collect()]
    # sorted, a token's tags are [I-a, O] at 3 and [I-a, I-b] at 4: the last type before 4 is O
    assert spans(P.merge_tags(df, ["doc"])) == [(0, 3, "a"), (4, 4, "a|b"), (6, 9, "b|c")]
    assert spans(P.merge_tags(df, ["doc"], sentence="s")) == [(0, 1, "a"), (2, 3, "a"), (4, 4, "a|b"), (6, 6, "b|c"), (9, 9, "b")]
    one = df.withColumn("tag", F.col("tag")[0])
    assert spans(P.merge_tags(one.where("pos < 4"), ["doc"])) == [(0, 3, "a")]


def test_word_rows_are_read_and_checked(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame([(1, "a", "s")], "sentence_id long, words string, source string").write.parquet(path)
    assert [tuple(r) for r in R.read_word_rows(spark, path).collect()] == [(1, "a", "s")]
    spark.createDataFrame([], "sentence_id long, words string, source string").write.mode("overwrite").parquet(path)
    assert R.read_word_rows(spark, path).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        R.read_word_rows(spark, path, ("sentence_id", "pos"))


def test_a_scorer_is_loaded_once_a_task(spark, tmp_path):
    log = tmp_path / "loads"
    log.mkdir()

    def load():
        (log / f"{random.random()}").touch()
        return lambda f: pd.DataFrame({"id": f["id"], "label": f["word"].str.len().map(lambda n: "long" if n > 2 else "short"), "probability": 1.0})

    df = spark.createDataFrame([(k, "w" * (k % 5)) for k in range(100)], "id long, word string").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # several batches a task
    try:
        got = {r["id"]: r["label"] for r in G.score_with(df, load, "id long, label string, probability double").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {k: "long" if k % 5 > 2 else "short" for k in range(100)}
    assert len(list(log.iterdir())) == 3
