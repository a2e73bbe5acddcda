from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexigrid.operators import corpus as C
from lexigrid.operators import tagging as TG
from lexigrid.session import cut

DDL = "doc_id long, source string, lang string, text string"


def test_paths_of_whole_sentences_are_those_of_words(spark, sf, monkeypatch):
    """No word known to all tasks, few, all: the same as over word rows; nulls, texts that share a name, no words, long texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "text").limit(60)
    odd = [(None, "x", "en", "a b c"), (None, "x", "en", "und der b"), (None, None, "en", "the"), (7_000, "x", None, "the of und"), (7_000, "x", "en", " of  a"), (7_001, "x", "en", None), (7_002, "x", "en", " \t ")]
    docs = docs.unionByName(spark.createDataFrame([*odd, (7_003, "x", "fr", "der les und " * 3_000)], DDL))
    by = ["source", "sentence_id"]
    rows, sentences = C.word_rows(docs), cut(C.whole_sentences(docs).withColumn("words", C.words_of("text")))
    flat = sentences.select(*by, F.posexplode("words").alias("pos", "word"))
    assert flat.count() == rows.count() and not flat.groupBy(*by, "word").count().exceptAll(rows.groupBy(*by, "word").count()).count()
    tagger = TG.fit_sentences(sentences, labels="types")
    plain = TG.fit_tagger(rows, by, label="type")
    assert (tagger.labels, tagger.starts, tagger.moves, tagger.unknown) == (plain.labels, plain.starts, plain.moves, plain.unknown)
    want = None
    scores = {r["word"]: r["scores"] for r in tagger.words.collect()}
    for most in (0, 40, 1_000_000):
        monkeypatch.setattr(TG, "MOST_KNOWN", most)
        monkeypatch.setattr(TG, "TASK_SCORES", 500 if most else 4_000_000)
        got = {(r["source"], r["sentence_id"]): (r["words"], r["pred_labels"], r["best_score"]) for r in TG.decode_sentences(sentences, tagger, by, keep=["words"]).collect()}
        want = want or got
        assert got == want and len(got) == sentences.count()
    for words, labels, best in list(want.values())[-12:]:
        path, score = TG.viterbi(np.array([scores.get(w, tagger.unknown) for w in words]), np.array(tagger.starts), np.array(tagger.moves))
        assert best == score and labels == [tagger.labels[k] for k in path]


def test_paths_of_sentences_without_words_or_with_nulls(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"], ["x", "y", "y"]), (2, [], []), (3, None, None), (4, ["b", "a"], [None, "x"])], "id long, words array<string>, labels array<string>")
    tagger = TG.fit_sentences(df)
    rows = df.select("id", F.inline_outer(F.arrays_zip("words", "labels")).alias("word", "label")).select("id", F.monotonically_increasing_id().alias("pos"), "word", "label")
    plain = TG.fit_tagger(rows, ["id"])
    assert (tagger.labels, tagger.starts, tagger.moves, tagger.unknown) == (plain.labels, plain.starts, plain.moves, plain.unknown)
    got = {r["id"]: r for r in TG.decode_sentences(df, tagger, ["id"]).collect()}
    assert [got[k]["best_score"] is None for k in (1, 2, 3, 4)] == [False, True, True, False]
    assert [len(got[k]["pred_labels"]) for k in (1, 2, 3, 4)] == [3, 0, 0, 2]


def test_viterbi_of_many_is_that_of_each():
    r = np.random.default_rng(3)
    sizes, k = r.integers(1, 9, 50), 3
    scores, starts, moves = r.integers(-3, 1, (sizes.sum(), k)), r.integers(-3, 1, k), r.integers(-3, 1, (k, k))
    path, best = TG.viterbi_all(scores, sizes, starts, moves)
    for n, end, score in zip(sizes, np.cumsum(sizes), best, strict=True):
        one, own = TG.viterbi(scores[end - n : end], starts, moves)
        assert one.tolist() == path[end - n : end].tolist() and own == score


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("others", [0, 1])
def test_best_label_paths_as_sql(spark, tmp_path, sf, others):
    """One id in two sources is two sentences. Frequent words are not shuffled one by one: all shuffles together write less than twice the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if others:
        docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("source", F.lit("other")))
    docs = docs.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 20))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    size, before = docs.agg(F.sum(F.octet_length("text"))).first()[0], shuffled(spark)
    got = sorted(map(tuple, entry.queries()["best_label_paths"](spark, str(tmp_path)).collect()))
    assert shuffled(spark) - before < 2 * size
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(entry.oracle_sql()["best_label_paths"]).fetchall())
