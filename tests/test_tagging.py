from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import tables as TF
from lexigrid.operators import budget as B
from lexigrid.operators import sequences as Q
from lexigrid.operators import spans as P
from lexigrid.operators import subwords as SW
from lexigrid.operators import tagging as TG
from lexigrid.plans.corpus_queries import t, words

MARK = "▁"


def path_score(path, scores, starts, moves):
    return starts[path[0]] + sum(moves[a][b] for a, b in itertools.pairwise(path)) + sum(s[k] for s, k in zip(scores, path, strict=True))


def best_path(scores, starts, moves):
    """All paths compared: the greatest score, then the smallest label where a path differs last from another."""
    paths = itertools.product(range(len(starts)), repeat=len(scores))
    return max(paths, key=lambda p: (path_score(p, scores, starts, moves), [-k for k in reversed(p)]))


def test_viterbi_is_the_best_of_all_paths():
    r = random.Random(1)
    for _ in range(400):
        n, k = r.randint(1, 6), r.randint(1, 4)
        draw = lambda *shape: np.array([r.randint(-3, 0) for _ in range(int(np.prod(shape)))]).reshape(shape)  # noqa: E731  many ties
        scores, starts, moves = draw(n, k), draw(k), draw(k, k)
        path, score = TG.viterbi(scores, starts, moves)
        want = best_path(scores.tolist(), starts.tolist(), moves.tolist())
        assert tuple(path.tolist()) == want and score == path_score(want, scores.tolist(), starts.tolist(), moves.tolist())


def test_tagger_over_sentences(spark):
    r, tags = random.Random(2), {"dog": "N", "cat": "N", "run": "NV", "sleep": "V", "the": "D"}
    rows = [("s", i, k, w, r.choice(tags[w])) for i in range(40) for k, w in enumerate(r.choice(list(tags)) for _ in range(5))]
    ddl = "source string, sentence_id long, pos int, word string, label string"
    tagger = TG.fit_tagger(spark.createDataFrame([*rows, ("s", 99, 0, None, "N"), ("s", 99, 1, "dog", None)], ddl), ["source", "sentence_id"])
    assert tagger.labels == ["D", "N", "V"]
    count = sum(w == "run" and x == "V" for *_, w, x in rows)
    total, kinds = sum(x == "V" for *_, x in rows), len(tags) + 1
    known = {x["word"]: list(x["scores"]) for x in tagger.words.collect()}
    assert known["run"][2] == int(np.floor(np.log((count + 0.1) / (total + 0.1 * kinds)) * 1_000_000)) and known["the"][1] == tagger.unknown[1]
    sents = {1: ["the", "dog", "run"], 2: ["run"], 3: ["new", None, "the", "cat"], 4: ["the"] * 6}
    df = spark.createDataFrame([("s", i, k, w) for i, ws in sents.items() for k, w in enumerate(ws)], "source string, sentence_id long, pos int, word string")
    got = TG.decode(df, tagger, ["source", "sentence_id"]).orderBy("sentence_id", "pos").collect()
    for i, ws in sents.items():
        scores = [known.get(w, tagger.unknown) for w in ws]
        want = best_path(scores, tagger.starts, tagger.moves)
        own = [x for x in got if x["sentence_id"] == i]
        assert [tagger.labels.index(x["pred_label"]) for x in own] == list(want) and [x["word"] for x in own] == ws
        assert {x["best_score"] for x in own} == {path_score(want, scores, tagger.starts, tagger.moves)}
    assert TG.decode(df.limit(0), tagger, ["source", "sentence_id"]).count() == 0
    none = TG.fit_tagger(spark.createDataFrame([], ddl), ["source", "sentence_id"])
    assert {x["pred_label"] for x in TG.decode(df, none, ["source", "sentence_id"]).collect()} == {None}


def test_languages_of_words(spark, sf):
    rows = words(spark, sf)
    tagger = TG.fit_tagger(rows.where("sentence_id % 5 > 0"), ["source", "sentence_id"], label="type")
    held = rows.where("sentence_id % 5 = 0")
    tagged = TG.decode(held, tagger, ["source", "sentence_id"]).join(held.select("source", "sentence_id", "pos", "type"), ["source", "sentence_id", "pos"])
    right, n = tagged.agg(F.count_if(F.col("pred_label") == F.col("type")), F.count("*")).first()
    assert right > 0.9 * n


def plain_pieces(word, vocabulary, longest=SW.LONGEST + 1):
    text, at, out = MARK + word, 0, []
    while at < len(text):
        piece = next((text[at : at + n] for n in range(longest, 0, -1) if at + n <= len(text) and text[at : at + n] in vocabulary), None)
        if piece is None:
            return [SW.UNKNOWN]
        out.append(piece)
        at += len(piece)
    return out


def test_trie_takes_the_longest_pieces_of_all_documents(spark, sf):
    docs = t(spark, sf, "documents")
    pieces = SW.count_pieces(words(spark, sf), most=3_000)
    vocabulary = {r["piece"] for r in pieces.collect()}
    assert len(vocabulary) == 3_000
    got = Q.subtoken_spans(docs, SW.trie_tokenizer(pieces)).orderBy("doc_id", "sub").collect()
    own = {}
    for r in got:
        own.setdefault(r["doc_id"], []).append(r["piece"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert own == {i: p for i, text in texts.items() if (p := [x for w in text.split() for x in plain_pieces(w, vocabulary)])}
    for i, text in list(texts.items())[:50]:  # spans hold what their piece says
        for r in (x for x in got if x["doc_id"] == i and x["start"] is not None):
            assert SW.UNKNOWN in own[i] or text[r["start"] : r["end"]] == r["piece"].replace(MARK, "")


def test_trie_of_few_pieces(spark):
    trie = SW.Trie([MARK + "a", MARK + "abc", "b", "cd", MARK])
    assert [trie.word(w) for w in ("abcd", "abcx", "ab", "b", "x", "abccd")] == [[SW.UNKNOWN], [SW.UNKNOWN], [MARK + "a", "b"], [MARK, "b"], [SW.UNKNOWN], [MARK + "abc", "cd"]]
    assert trie(" ab  b ") == [MARK + "a", "b", MARK, "b"] and trie("") == []
    df = spark.createDataFrame([("ab",), ("ab",), (None,), ("",)], "word string")
    assert {(r["piece"], r["n"]) for r in SW.count_pieces(df).collect()} == {(MARK, 2), (MARK + "a", 2), (MARK + "ab", 2), ("a", 2), ("b", 2), ("ab", 2)}
    with pytest.raises(ValueError):
        SW.trie_tokenizer(SW.count_pieces(df), most=2)


def test_running_sums_and_minutes(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, 0, 3, 50, 400])) for k in range(500)]
    df = spark.createDataFrame(r.sample(rows, 500), "id long, n long").repartition(7)
    got = B.schedule(df, ["id"], F.col("n"), F.col("n") * 2, 1_000, 30_000).orderBy("id").collect()
    before = 0
    for x, (k, n) in zip(got, rows, strict=True):
        assert (x["id"], x["tokens_before"], x["cost_before"], x["minute"], x["sent"]) == (k, before, 2 * before, before // 1_000, 2 * before < 30_000)
        before += n or 0
    assert B.schedule(df.limit(0), ["id"], F.col("n"), F.col("n"), 1, 1).count() == 0
    with pytest.raises(ValueError):
        B.schedule(df, ["id"], F.col("n"), F.col("n"), 0, 1)


def test_chunks_in_sql_of_values_and_of_a_table(spark):
    TF.register(spark)
    docs = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, ""), (4, "x" * 25)], "doc_id long, text string")
    want = {(i, k, a, z, text[a:z]) for i, text in ((1, "A b. C d."), (4, "x" * 25)) for k, (a, z) in enumerate(P.chunk_spans(text, 8))}
    got = spark.sql("SELECT doc_id, c.* FROM {d} d, LATERAL text_chunks(d.text, 8) c", d=docs)
    assert {tuple(r) for r in got.collect()} == want
    got = spark.sql("SELECT * FROM text_chunks(TABLE(SELECT * FROM {d}) PARTITION BY (doc_id), 8)", d=docs)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["doc_id", "chunk", "start", "end", "piece"]
    with pytest.raises(Exception, match="whole number"):
        spark.sql("SELECT * FROM text_chunks('a', 0)").collect()
