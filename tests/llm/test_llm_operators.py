from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter
from functools import cache
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import bpe, common, decontaminate, exact_dedup, html_extract, lang_id, license_scan, lm_score, near_dedup, queries, simhash, toxicity, url_filter
from lexigrid.llm.common import connected_components, table

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fingerprint string, x string, fp string, id string, label string, score string, digest string, key string, uid string, item_id string, held_out string"
TEXTS = [None, "", " \t\n", "one", "One", "a b  c", "a\tb c", "CC BY license", "x" * 5000, "w " * 3000, "Ünïcödé ß 中文 🙂", "a b  c", "idiot clown", "<|endoftext|> hi", "\x0b\x0c\r"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, t, None if k % 3 else "en", None, None, *["c"] * 12) for k, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s", 3, *[None] * 12), (None, "one", "en", None, None, *["c"] * 12), (None, None, None, None, None, *["c"] * 12)]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").cache()


@pytest.fixture(scope="module")
def labels(spark, sf):
    return table(spark, sf, "labels")


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def by_row(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def brute_exact(rows):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(plain(t).encode()).hexdigest(), []).append(i)
    out = []
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, h) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [2, 4, 4096])
def test_exact_dedup(edge, docs, heavy):
    for df in (edge, docs, edge.limit(0)):
        want = brute_exact([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        assert by_row(exact_dedup.exact_dedup(df, heavy=heavy)) == want


def test_exact_dedup_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for name, sql in queries.ORACLE.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        rows = [sorted(map(str, f[cols].fillna("null").astype(str).values.tolist())) for f in (got, want)]
        assert sorted(got.columns) == cols and rows[0] == rows[1]


def test_drop_copies_keeps_columns(edge):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert len({plain(r["text"]) for r in kept.collect()}) == len({plain(t) for t in TEXTS})


REPEATED = [(1, "b b b b"), (2, "alpha beta gamma delta"), (2, "b b b b"), (None, "unique words stand here now"), (None, "b b b b"), (1, "b b b b")]


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.drop_near_duplicates, near_dedup.drop_near_duplicates])
def test_dropping_copies_loses_no_text(spark, monkeypatch, drop, most):
    """Repeated ids with other texts and null ids: only what another id keeps goes, by broadcast or by shuffle."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    df = spark.createDataFrame([(*r, "c", "c") for r in REPEATED], "doc_id long, text string, __gone string, __mark string")
    got = drop(df)
    assert got.columns == df.columns
    assert by_row(got.select("doc_id", "text")) == sorted([REPEATED[0], REPEATED[0], REPEATED[1], REPEATED[3]], key=repr)


def test_join_by_key_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 3)
    rows = spark.createDataFrame([(k, 0 if k < 60 else k) for k in range(100)], "id long, key long")
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = common.join_by_key(rows, facts, "key", "n")
    assert got.columns == ["key", "id", "least"]
    assert sorted((r["id"], r["least"]) for r in got.collect()) == [(k, 0 if k < 60 else k) for k in range(100)]


def test_unfinished_components_are_an_error(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        connected_components(chain, most_rounds=1)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Cluster(), type("C", (), {"get": staticmethod(lambda key, default: None)})

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())


# 2


def brute_print(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(prints))]


@pytest.mark.parametrize("most", [4096, 2])
def test_simhash(spark, edge, docs, most, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_MOST", most)
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, most))
    for df in (edge, docs.where("doc_id < 150"), edge.limit(0)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        prints = [brute_print(t) for _, t in rows]
        roots = brute_components(prints)
        least: dict = {}
        for (i, _), r in zip(rows, roots, strict=True):
            if i is not None:
                least[r] = min(i, least.get(r, i))
        want = sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)
        assert by_row(simhash.near_duplicates(df)) == want


def test_bk_tree_finds_all_and_shards_hold_every_link():
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 2**63, 20)]
    values = sorted({b ^ sum(1 << int(k) for k in r.integers(0, 64, n)) for b in base for n in (0, 1, 1, 2, 3)})
    tree, seen = simhash.BKTree(), []
    for v in values:
        assert sorted(tree.values[k] for k in tree.add_and_search(v, 2)) == sorted(s for s in seen if (s ^ v).bit_count() <= 2)
        seen.append(v)
    masks = simhash.fixed_masks(2)
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                assert all(any((a & m) == (b & m) for m in level) for level in masks)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


def test_license_base_against_regex(edge, docs):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for df in (edge, docs):
        got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.scan_licenses(df).collect()}
        want = set()
        for r in df.select("doc_id", "text").collect():
            low = "".join(c.lower() if c.isascii() else c for c in r["text"] or "")
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            hits = [(k, p) for p in phrases for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
            places = [k for k, _ in hits]
            want.add((r["doc_id"], len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({phrases[p] for _, p in hits}))))
        assert got == want
    assert license_scan.scan_licenses(edge.limit(0)).count() == 0


def test_license_rules():
    s = license_scan.Scanner()
    assert len(s.rules) > 200
    for r, pattern in s.rules:
        assert r.keyword and r.keyword in license_scan.keyword_of(r.pattern) or r.keyword in ("spdx", "licen") or re.search(re.escape(r.keyword), r.pattern), r
        assert pattern.pattern
    assert s.scan("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file")[5] == "apache-2.0"
    assert s.scan("GNU Lesser General Public License v2.1")[5] == "gpl,lgpl-2.1"
    assert s.scan("SPDX-License-Identifier: MIT\n")[5] == "mit"
    n, places, first, last, base, labels, score, spans = s.scan("(c) All Rights Reserved. All rights reserved")
    assert (n, places, first, last, base) == (7, 2, 1, 4, "reserved") and 0 <= score <= 1
    assert s.scan("nothing here")[4:7] == ("", "", 0.0)


def brute_detections(line, rules):
    """Every rule on every text, and every pair of detections compared."""
    found = sorted((r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.weight) for r, p in rules for m in p.finditer(line))
    standing = []
    for x in found:
        if not any(y[2] <= x[2] and x[3] <= y[3] or y[0] < x[0] and x[2] < y[3] and y[2] < x[3] for y in standing):
            standing.append(x)
    return sorted(x[2:] for x in standing)


def test_license_suppression_labels_and_score_against_brute_force(docs):
    s = license_scan.Scanner()
    r = np.random.default_rng(4)
    pieces = ["GNU General Public License", "version 2", "or later", "Apache License", "MIT", "licensed under the", "BSD 3 clause", "all rights reserved", "cc by", "sa 4 0", "SPDX-License-Identifier: MIT", "either version 3 of the", "any later version", "words", "public domain", "into the", "copyright 2020", "Lesser", "GNU", "license"]
    texts = [" ".join(r.choice(pieces, int(r.integers(1, 14)))) for _ in range(400)] + [x["text"] for x in docs.collect()]
    for text in texts:
        line = s.words(text)
        want = brute_detections(line.decode("utf-8", "surrogatepass"), s.rules) if len(line) > 1 else []
        got = s.scan(text)
        base = set(got[4].split(",")) - {""}
        score = 1 - math.prod([0.5 if base else 1.0, *(1 - x[3] for x in want)])
        assert set(got[5].split(",")) - {""} == base | {x[2] for x in want}
        assert got[6] == pytest.approx(score)
        words = line.decode("utf-8", "surrogatepass").split()
        spans = [(x["label"], " ".join(words[x["start"] : x["end"]])) for x in got[7]]
        assert spans == [(x[2], line.decode("utf-8", "surrogatepass")[x[0] : x[1]].strip()) for x in want]


def test_license_long_texts_take_linear_time():
    s = license_scan.Scanner()
    began = time.process_time()
    got = s.scan("Licensed under the GNU General Public License version 2 or later, all rights reserved. " * 100_000)
    assert time.process_time() - began < 20
    assert got[1] == 200_000 and len(got[7]) >= 100_000


def test_license_sentences_hold_their_keyword(spark):
    for _, keyword, pattern in license_scan.SENTENCES:
        assert keyword in re.sub(r"\(\?:[^()]*\)\??", "\0", re.sub(r"\((?:\?:)[^()]*\)\?", "\0", pattern)), pattern
    text = "under the terms of either version 3 of the license, or (at your option) any later version."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert any("gpl" in str(x) for x in license_scan.scan_licenses(df).first())


# 4


def small_model(seed=0):
    r = np.random.default_rng(seed)
    v = lm_score.Vocabulary(Path(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")).read_bytes())
    classes = lm_score.Classes.from_counts(r.integers(0, 50, v.end + 1).astype(float))
    return lm_score.LanguageModel(v, classes, some_pairs(r), r.normal(0, 0.3, lm_score.Attention.SIZE).astype(np.float32))


def some_pairs(r):
    n = lm_score.CLASSES
    return lm_score.Pairs.from_counts(r.integers(0, 9, (n, n)) * (r.random((n, n)) < 0.05), r.integers(0, 50, n), r.integers(0, 50, n), np.full(n, 1 / n))


def test_lm_score_token_by_token():
    m = small_model()
    sub, net, cl = lm_score.subwords_of(m.vocabulary), lm_score.Attention(m.flat, m.pairs), m.classes
    texts = [None, "", "a", "The quick fox " * 30, " ".join(f"w{k}" for k in range(90))]
    fresh = lm_score.WINDOW - lm_score.CONTEXT
    for text, got in zip(texts, m.score(texts, 3), strict=True):
        s, total = [sub.end, *sub.texts([lm_score.words_of(text)])[0].tolist(), sub.end], 0.0
        for k in range(len(s) - 1):
            lo = 0 if k < lm_score.WINDOW else math.ceil((k + 1 - lm_score.WINDOW) / fresh) * fresh
            e = net.emb[cl.of[s[lo : k + 1]]].astype(float) + net.pos[: k + 1 - lo]
            a = np.exp((e @ net.q)[-1] @ (e @ net.k).T / math.sqrt(lm_score.WIDTH))
            h = e[-1] + (a / a.sum()) @ (e @ net.v) @ net.o
            h = h + np.maximum(h @ net.a, 0) @ net.b
            group, member = divmod(int(cl.of[s[k + 1]]), lm_score.MEMBERS)
            last = int(cl.of[s[k]])
            for z, at in ((h @ net.top + net.top_bias + m.pairs.top[last], group), (h @ net.out[group] + net.bias[group] + m.pairs.inside[last, group], member)):
                total += z[at] - math.log(np.exp(z).sum())
            total += cl.inside[s[k + 1]]
        assert got == pytest.approx(total / math.log(10), rel=1e-4)


def test_lm_words_learned_together_are_as_alone(docs):
    """Words that are encoded in one text have the ids that each has alone after a space."""
    m = small_model()
    words = sorted({w for r in docs.limit(60).collect() for w in lm_score.words_of(r["text"])} | set(lm_score.words_of("it's 's '12 a'b #x ~~ é 中文 🙂 x1y2 don't -- <|endoftext|>")))
    odd = ["a\xa0", "\xa0b", "\u2003", "\x1c", "\x85x", "bad\ud800"]
    for part in (words, words[:1], lm_score.words_of(" ".join(odd)), [*words[:9], *lm_score.words_of(" ".join(odd))]):
        learned = lm_score.Subwords(m.vocabulary).packed(part)
        for w, ids in zip(part, learned, strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == m.vocabulary.tokenizer().encode_ordinary(" " + w.decode("utf-8", "replace"))


def test_lm_gathers_in_one_pass(spark, docs):
    """Counts of all words and texts, and windows of their ids: one a text and one more for each WINDOW_CHARS characters, repeated rows too."""
    vocabulary = spark.sparkContext.broadcast(small_model().vocabulary)
    rows = docs.select("doc_id", "text").union(docs.select("doc_id", "text").limit(5)).union(spark.createDataFrame([(None, None), (None, None), (7, "x " * 9000)], "doc_id long, text string"))
    got = lm_score.gather(rows, "doc_id", "text", vocabulary).collect()
    texts = [r["text"] for r in rows.collect()]
    want = Counter(w for t in texts for w in lm_score.words_of(t))
    assert {bytes(r["word"]): r["c"] for r in got if r["kind"] == lm_score.WORD} == want
    assert [r["c"] for r in got if r["kind"] == lm_score.END] == [len(texts)]
    windows = [r for r in got if r["kind"] == lm_score.PIECE]
    assert sum(r["c"] for r in windows) == sum(1 + len(t or "") // lm_score.WINDOW_CHARS for t in texts)
    sub, end = lm_score.subwords_of(vocabulary.value), vocabulary.value.end
    whole = [np.array([end, *ids, end], "<u2").tobytes() for ids in sub.texts([lm_score.words_of(t) for t in texts])]
    assert all(len(r["word"]) <= 8 + 2 * (lm_score.WINDOW + 1) and any(bytes(r["word"])[8:] in t for t in whole) for r in windows[:200])
    most = lm_score.most_frequent(spark.createDataFrame([(bytearray(b"%d" % k), 1 + k) for k in range(100)], "word binary, c long"), 30)
    assert 20 <= len(most) <= 30 and min(most.values()) == 101 - len(most)


def test_lm_pairs_against_plain_counts(spark):
    """Shares after each class, from a text in which every word's ids are counted one by one."""
    m = small_model()
    vocabulary, of = spark.sparkContext.broadcast(m.vocabulary), m.classes.of
    words = [(b"strange", 3), (b"xyzzyq", 2), (b"a", 5), ("\u00e9t\u00e9".encode(), 1)]
    neighbours = lm_score.id_pairs(spark.createDataFrame([(bytearray(w), c) for w, c in words], "word binary, c long"), vocabulary)
    got = lm_score.class_pairs(neighbours, m.classes, 4)
    sub = Counter({k: 0 for k in range(10)})
    for w, c in words:
        for k in m.vocabulary.tokenizer().encode_ordinary(" " + w.decode()):
            sub[k] += c
    assert {k: n for k, n in enumerate(lm_score.subword_counts(neighbours, m.vocabulary.end + 1)) if n} == {k: n for k, n in sub.items() if n}
    n = lm_score.CLASSES
    count, firsts, lasts = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    for w, c in words:
        ids = of[m.vocabulary.tokenizer().encode_ordinary(" " + w.decode())]
        firsts[ids[0]] += c
        lasts[ids[-1]] += c
        for a, b in zip(ids, ids[1:]):
            count[a, b] += c
    firsts[of[-1]] += 4
    lasts[of[-1]] += 4
    count += np.outer(lasts, firsts / firsts.sum()) + lm_score.PAIR_PRIOR * m.classes.shares
    count /= count.sum(axis=1, keepdims=True)
    whole = np.exp(got.top[:, :, None] + got.inside).reshape(n, n)
    assert np.allclose(whole, count, rtol=1e-3, atol=1e-9)


def test_lm_gradient_and_training():
    r = np.random.default_rng(3)
    pairs = some_pairs(r)
    net = lm_score.Attention(r.normal(0, 0.2, lm_score.Attention.SIZE).astype(np.float32), pairs)
    x = r.integers(0, lm_score.CLASSES, (4, lm_score.WINDOW + 1))
    ok = r.random((4, lm_score.WINDOW)) < 0.8

    def loss(flat):
        n = lm_score.Attention(flat, pairs)
        rows = n.last(x[:, :-1], np.full(4, lm_score.WINDOW), np.zeros(4, int))[ok.ravel()]
        return -float(n.log_shares(rows, x[:, :-1][ok], x[:, 1:][ok]).astype(float).mean())

    g, d = net.gradient(x[:, :-1], x[:, 1:], ok), r.normal(0, 1, lm_score.Attention.SIZE).astype(np.float32)
    assert (loss(net.flat + 2e-3 * d) - loss(net.flat - 2e-3 * d)) / 4e-3 == pytest.approx(float(g @ d), rel=0.05, abs=0.02)
    assert loss(net.train(x, ok, 60, 0.02, 1).flat) < loss(net.flat)


def test_lm_training_reads_every_window_in_every_round(spark, monkeypatch):
    seen: list = []
    monkeypatch.setattr(lm_score.Attention, "gradient", lambda self, x, y, ok: seen.extend(x[:, 0].tolist()) or np.zeros_like(self.flat))
    count = 3 * lm_score.STEP_WINDOWS - 5
    windows = np.repeat(np.arange(count)[:, None], lm_score.WINDOW + 1, axis=1)
    lm_score.Attention(np.zeros(lm_score.Attention.SIZE, np.float32), some_pairs(np.random.default_rng(0))).train(windows, np.ones((count, lm_score.WINDOW), bool), 3, 0.01, 1)
    assert set(seen) == set(range(count))
    monkeypatch.undo()

    def no_part(*_):
        raise AssertionError("a round must not take a part of the windows")

    monkeypatch.setattr(lm_score, "TASK_WINDOWS", 2)
    monkeypatch.setattr(lm_score.F, "pmod", no_part)
    classes = lm_score.Classes.from_counts(np.arange(2000.0))
    rows = spark.createDataFrame([(k, bytearray(np.arange(20, dtype="<u2").tobytes())) for k in range(9)], "key long, ids binary")
    assert np.isfinite(lm_score.train_attention(rows, classes, some_pairs(np.random.default_rng(0)))).all()


def test_lm_base_score(edge):
    got = lm_score.score_corpus(edge, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(words(t)), sum(w in c for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_lm_rare_words_take_the_join(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").limit(40)
    path = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    all_common = {r["doc_id"]: r for r in lm_score.score_corpus(docs, path).collect()}
    monkeypatch.setattr(lm_score, "MOST_KNOWN", 50)
    for r in lm_score.score_corpus(docs, path).collect():
        a = all_common[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (a["n_tokens"], a["n_known"]) and r["base_score"] == pytest.approx(a["base_score"])


def test_lm_empty(edge):
    assert lm_score.score_corpus(edge.limit(0), queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")).count() == 0


# 5


def brute_verdict(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x", "https://example.com/en/8", "http://xcom/en/", "http://b.example.net/de/81#a", "http://example.net/de/1", "x://www.casino-win.example.org/en/14.html?q#z", "http://casino-win.example.org/en/14000", "http://org/es/", "http://a.com?x=/en/", "http://a.com/en/\nz", "a://b://c.com/en/", "https://m.casino-win.example.com/fr/9999/"]
LISTED = {9, 15}


def test_url_filter(spark):
    df = spark.createDataFrame([(k, u, "c", "c", "c") for k, u in enumerate(URLS)] + [(None, None, "c", None, "c"), (4, URLS[4], "c", "c", "c")], "page_id long, url string, host string, path string, key string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule = brute_verdict(URLS[r["page_id"]] if r["page_id"] is not None else None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0] if rule else None)
        assert r["verdict"] == (rule[1] if rule else "block" if r["page_id"] in LISTED else "allow")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 23, 0])
def test_bloom_has_no_false_negative_and_the_join_removes_false_positives(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "HIT_BYTES", most)
    listed = spark.range(3000).select(F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".x/p/"), "id").alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h"), F.col("id") % 7, F.lit(".x/p/"), "id", F.lit("/?a=1")).alias("url"))
    pages = pages.union(pages.where("page_id = 5").crossJoin(spark.range(500)).select("page_id", "url"))  # a popular URL
    tight = url_filter.bloom_blocks(url_filter.listed_keys(listed), most_bytes=64)  # one block: passes nearly all
    assert tight.shape == (1, 8)
    for blocks in (tight, None):
        if blocks is not None:
            monkeypatch.setattr(url_filter, "bloom_blocks", lambda keys, blocks=blocks: blocks)
        got = url_filter.filter_urls(pages, rules=(), listed=listed)
        assert got.count() == 6500
        assert got.where((F.col("verdict") == "block") != (F.col("page_id") < 3000)).count() == 0
    assert url_filter.filter_urls(pages, rules=(), listed=listed.limit(0)).where("verdict = 'block'").count() == 0


# 6


def test_language(docs, edge):
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    got = {r["doc_id"]: r for r in lang_id.identify(docs, model).collect()}
    rows = docs.select("doc_id", "lang", "text", lang_id.held_out().alias("h")).collect()
    held = [r for r in rows if r["h"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    found = {repr(r["doc_id"]): r["lang_pred"] for r in lang_id.identify(edge, model).collect()}
    assert [found[str(k)] for k in (0, 1, 2, 14)] == ["und"] * 4
    assert {r["lang_pred"] for r in lang_id.identify(edge, lang_id.fit(edge.limit(0))).collect()} == {"und"}
    assert lang_id.identify(edge.limit(0), model).count() == 0


def test_language_word_by_word(docs):
    model = lang_id.fit(docs)
    for text in [r["text"] for r in docs.limit(5).collect()] + ["zzz the qqqq", "é"]:
        total = np.zeros(len(model.langs))
        for w in lang_id.find_words(text.lower()):
            k = model.tables[0].get(w)
            total += model.matrix[k] if k is not None else model.unseen(w)
        p = np.exp((total - total.max()) * math.log(10))
        assert model.predict(text) == (model.langs[int(total.argmax())], pytest.approx(p.max() / p.sum(), abs=1e-6))


# 7


@cache
def html_model():
    return html_extract.train()


def brute_marginals(model, nodes, unary, kinds):
    total, out = 0.0, np.zeros(len(nodes))
    for y in np.ndindex(*[2] * len(nodes)):
        s = sum(u for u, v in zip(unary, y, strict=True) if v) + sum(model.e[kinds[k], y[nodes[k].parent], y[k]] for k in range(1, len(nodes)))
        total, out = total + math.exp(s), out + math.exp(s) * np.array(y)
    return out / total


def test_html_messages_are_exact():
    m = html_model()
    nodes, _ = html_extract.parse("<nav><a>x</a></nav><article><p>a<b>c</b></p><div class=ad>x</div></article>")
    unary = [float(m.w[html_extract.features(x)].sum()) for x in nodes]
    kinds = [html_extract.kind(x, html_extract.features(x)) for x in nodes]
    assert m.marginals(nodes, unary, kinds)[0] == pytest.approx(brute_marginals(m, nodes, unary, kinds).tolist())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""),
        ("<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T &amp; U</h1><p>One\n  two&nbsp;three and some more words here.<br><p><b>Four five six seven.</b></article><footer>&copy; x</footer>", "T & U\nOne two three and some more words here.\nFour five six seven."),
        ("<article><p>The text of the article stands here, long enough.</p><div class='comments'><p>First! A reader writes this comment.</p></div><form><label>Name</label></form></article>", "The text of the article stands here, long enough."),
        ("<script>var t='</p><p>no';</script><main><p>Some content of the main part of a page.</p></main><aside><p>See also the other thing.</p></aside>", "Some content of the main part of a page."),
    ],
)
def test_html_pages(page, want):
    assert html_model().extract(page) == want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_html_on_the_pages(spark, size):
    import html

    for r in html_extract.extract_text(table(spark, f"/root/testdata/{size}", "pages"), keep=("page_id", "html")).collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_articles_of_short_paragraphs():
    model = html_extract.train()
    for n in (1, 2, 5, 20, 50, 200, 1000):
        for text in ("x", "short words ok", "a paragraph of plain text that is rather longer than the short ones are"):
            page = f"<html><body><nav><ul><li><a href=a>home</a></ul></nav><article><h1>The title</h1>{f'<p>{text}</p>' * n}</article><aside><p>related things</p></aside><footer>&copy; x</footer></body></html>"
            assert model.extract(page) == "\n".join(["The title", *[text] * n]), (n, text)


@pytest.mark.parametrize("page", ["<a " * 100_000, '<a "' * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<!-- " * 100_000, "<b>" * 30_000 + "<p>x" * 30_000, "<ul><li>" * 30_000, "<a b='x>" * 50_001, "&amp" * 100_000])
def test_html_long_pages_take_linear_time(page):
    model = html_extract.train()
    began = time.process_time()
    model.extract(page)
    assert time.process_time() - began < 10


def test_html_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", "<article><p>one &amp; two</p></article>", "c", "c"), (1, "u", "<article><p>one &amp; two</p></article>", "c", "c"), (None, None, None, None, None), (2, "v", "", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    assert by_row(html_extract.extract_text(df)) == sorted([(1, "u", "one & two", 9), (1, "u", "one & two", 9), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_html_trains_on_other_pages():
    held = html_extract.labelled_pages(40, seed=99)
    right = total = 0
    for page in held:
        nodes, _ = html_extract.parse(page)
        marginal, _ = html_model().of_page(page)
        y: list[int] = []
        for x in nodes:
            y.append(1 if "data-y" in x.attrs else 0 if "data-n" in x.attrs or html_extract.GROUP.get(x.tag) in ("raw", "head") else y[x.parent] if x.parent >= 0 else 0)
        right += sum((m >= 0.5) == bool(v) for m, v in zip(marginal, y, strict=True))
        total += len(y)
    assert right >= 0.95 * total


# 8


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(queries.tokenizer_file("byte_bpe_50k.json")))


def test_bpe_like_the_library(codec, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    r = np.random.default_rng(5)
    odd = ["".join(chr(int(c)) for c in r.choice([32, 9, 10, 39, 65, 97, 115, 228, 0x4E2D, 0x1F642, 48, 0xA0, 0x301], 60)) for _ in range(200)]
    for t in [*(x or "" for x in TEXTS), *odd, "a<|endoftext|><|endoftext|>b", "ab" * 4000, *(r["text"] for r in docs.limit(60).collect())]:
        want = lib.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert got.tolist() == want
        assert codec.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_bpe_short_and_long_words_agree(codec):
    r = np.random.default_rng(6)
    for n in (1, 2, 3, 30, 64, 200):
        ids = [codec.byte_ids[int(b)] for b in r.choice(list(b"thesandi oe"), n)]
        assert codec.merge_short(list(ids)) == codec.merge_long(list(ids))


def test_bpe_queries(edge):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    ids = {repr(r["doc_id"]): r["ids"] for r in bpe.encode(edge, path).collect()}
    for r in bpe.round_trip_digests(edge, path).collect():
        got = ids[repr(r["doc_id"])]
        if r["doc_id"] is not None:
            assert (r["n_tokens"], r["ids_sha256"]) == (len(got), hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(edge, path), path)
    assert sorted(repr(r["text"]) for r in back.collect()) == sorted(repr(r["text"] or "") for r in edge.select("text").collect())
    assert bpe.with_token_count(edge.limit(0), path).count() == 0


# 9


def brute_neighbours(vectors, q, k):
    """(cosine, number) of the k nearest of {term: weight} vectors, by the plain sum over their terms."""
    cosines = [(round(sum(w * v.get(t, 0) for t, w in q.items()), 12), -j) for j, v in enumerate(vectors)]
    return [(s, -j) for s, j in sorted(cosines, reverse=True)[:k] if s > 0]


@pytest.mark.parametrize("n", [1, 15, 3000])
def test_toxicity_index_is_exact(n):
    r = np.random.default_rng(n)

    def vector(most):
        terms = np.unique((60 * r.random(int(r.integers(1, most))) ** 3).astype(np.int32))  # some terms are common, some rare
        weights = r.random(len(terms)) + 0.1
        return terms, weights / np.sqrt(weights @ weights)

    vectors = [vector(6) for _ in range(n)]
    vectors += vectors[: n // 3]  # ties
    index = toxicity.BlockMax(vectors, 60)
    plain_vectors = [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in vectors]
    queries = [vector(9) for _ in range(40)]
    for k in (1, 15, 40):
        for (t, w), got in zip(queries, index.nearest(queries, k), strict=True):
            want = brute_neighbours(plain_vectors, dict(zip(t.tolist(), w.tolist(), strict=True)), k)
            assert [j for _, j in got] == [j for _, j in want]
            assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-9)
    assert toxicity.BlockMax([], 60).nearest(queries[:2]) == [[], []]


def brute_toxicity(examples, texts):
    """Scores and evidence of texts from (id, label, text) examples, written out from the rules without the module's index."""
    examples = sorted(examples, key=lambda x: x[:2])
    find = re.compile(r"[^\W\d_]+").findall
    words = [Counter(find((t or "").lower())) for *_, t in examples]

    def all_terms(c):
        out = Counter(c)
        for w, k in c.items():
            for n in (3, 4, 5):
                if len(w) > n:
                    out["^" + w[:n]] += k
        return out

    total, n_yes = len(examples), sum(y for _, y, _ in examples)
    yes, no = Counter(), Counter()
    for (_, y, _), c in zip(examples, words, strict=True):
        (yes if y else no).update(set(all_terms(c)))
    g = {}
    for t in set(yes) | set(no):
        if (n := yes[t] + no[t]) >= toxicity.LEAST_ROWS:
            cells = [(yes[t], n * n_yes / total), (no[t], n * (total - n_yes) / total), (n_yes - yes[t], (total - n) * n_yes / total), (total - n_yes - no[t], (total - n) * (total - n_yes) / total)]
            g[t] = 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)
    marks = {t for t, x in g.items() if x > 3.84}

    def vector(counts):
        for terms in ({t: k for t, k in all_terms(counts).items() if t in marks}, {t: k for t, k in counts.items() if t in g}):
            if terms:
                v = {t: (1 + math.log(k)) * math.log(1 + total / (yes[t] + no[t])) for t, k in terms.items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                return bool(set(terms) & marks), {t: x / norm for t, x in v.items()}
        return False, {}

    placed = [vector(c) for c in words]
    out = []
    for text in texts:
        marked, q = vector(Counter(find((text or "").lower())))
        side = [k for k, (m, _) in enumerate(placed) if m == marked and placed[k][1]]
        rest = [y for (_, y, _), (m, _) in zip(examples, placed, strict=True) if not m]
        prior = n_yes / total if marked else (sum(rest) + n_yes / total) / (len(rest) + 1)
        near = [(s, side[j]) for s, j in brute_neighbours([placed[k][1] for k in side], q, 15)] if q else []
        weights = [1 / (1.1 - s) for s, _ in near]
        score = (sum(w for w, (_, k) in zip(weights, near, strict=True) if examples[k][1]) + prior) / (sum(weights) + 1)
        out.append((score, [examples[k][0] for _, k in near]))
    return out


def test_toxicity_against_brute_force(spark, edge, monkeypatch):
    """Marks, neighbours, votes and evidence over whole texts."""
    monkeypatch.setattr(toxicity, "without_copies", lambda rows: rows)
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    assert index.marks and len(index.ids[1])
    rows = docs.join(labels, "doc_id").where("toxic is not null").select("doc_id", "toxic", "text").collect()
    asked = [r["text"] for r in docs.orderBy("doc_id").limit(150).collect()] + TEXTS
    got = index.scores(asked)
    for (score, evidence), (want, nearest) in zip(got, brute_toxicity([tuple(r) for r in rows], asked), strict=True):
        assert score == pytest.approx(want, abs=1e-6)
        assert evidence == nearest
    scored = {r["doc_id"]: (r["score"], r["evidence"]) for r in toxicity.score(docs.orderBy("doc_id").limit(150), index).collect()}
    assert sorted(scored.values(), key=repr) == sorted(got[:150], key=repr)


def test_toxicity(spark, edge):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [r for r in toxicity.score(docs, index).collect() if r["doc_id"] in truth]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) >= 0.94 * len(got)
    assert not any(r["predicted"] for r in got if not truth[r["doc_id"]])
    assert toxicity.score(edge, index).count() == edge.count()
    blank = toxicity.fit(docs.limit(0), labels)
    assert {r["score"] for r in toxicity.score(edge, blank).collect()} == {0.0}
    assert toxicity.drop_toxic(edge, index).columns == edge.columns


def test_toxicity_held_out(spark):
    """Most held-out toxic rows are found, next to no clean one, and scores are shares: by tenths they are near the labels."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    rows = toxicity.score(docs.join(labels.where(toxicity.held_out()).select("doc_id"), "doc_id", "left_semi"), index).join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["toxic"]]
    print("toxic", len(toxic), "found", sum(r["predicted"] for r in toxic), "clean rejected", sum(r["predicted"] for r in rows if not r["toxic"]))
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.005 * len(rows)
    assert sum(bool(r["evidence"]) for r in rows) >= 0.99 * len(rows)
    off = sum(abs(sum(r["score"] - r["toxic"] for r in part)) for k in range(11) if (part := [r for r in rows if int(r["score"] * 10) == k]))
    assert off <= 0.02 * len(rows)  # expected calibration error


def test_toxicity_labels_ties_and_repeats(spark):
    """Of several labels of an id the largest counts, null labels and ids don't, repeated documents count and get a row each; ties go by id."""
    texts = [(k, f"rotten word{k} rotten a b c d{k}") for k in range(40)] + [(100 + k, f"good word{k} kind a b c e{k}") for k in range(40)]
    docs = spark.createDataFrame([*texts, (0, texts[0][1]), (None, "rotten")], "doc_id long, text string")
    marks = [(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(40)] + [(0, 0), (1, None), (None, 0), (999, 1)]
    index = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {"rotten", "good"} <= set(index.marks)
    assert sum(index.labels[0]) == 41 and len(index.labels[0]) == 81  # document 0 is there twice
    got = toxicity.score(docs, index).collect()
    assert len(got) == 82 and sum(r["predicted"] for r in got) == 42
    tie, _ = index.score("rotten"), index.score("nothing known")
    assert tie[1] == sorted(tie[1])


# 10


def smith_waterman(a, b):
    s = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i][j] = max(0, s[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 1, s[i][j - 1] - 1)
    return max(map(max, s))


def test_alignment_scores():
    r = np.random.default_rng(9)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 20))
        score, matched, used, start, end = decontaminate.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        assert matched <= used <= len(a) and 0 <= start <= end <= len(b)


def test_decontamination(spark, edge):
    words = [f"word{k}" for k in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[30:])), (3, ""), (4, None), (5, "solo"), (6, " ".join(f"l{k}" for k in range(130)))], "item_id long, text string")
    edited = [w if k % 7 else "changed" for k, w in enumerate(words[:30])]
    texts = {
        100: "before " * 20 + " ".join(words[:30]) + " after" * 20, 101: "x y " + " ".join(edited) + " z", 102: " ".join(words[:12]), 103: ", ".join(w.upper() for w in words[30:]) + "!",
        104: " ".join(w if k % 3 else "no" for k, w in enumerate(words[:30])), 105: "a solo b", 106: " ".join(f"l{k}" for k in range(40, 110)), 107: " ".join(words[k] for k in range(30) if k % 9), 108: "soloist",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(100, 1), (101, 1), (103, 2), (105, 5), (106, 6), (107, 1)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(df, items).collect()} == {102, 104, 108}
    assert decontaminate.contaminated(edge, items.limit(0)).count() == 0
    assert decontaminate.contaminated(edge.limit(0), items).count() == 0
    assert decontaminate.drop_contaminated(edge, items).count() == edge.count()


def test_decontamination_in_blocks(spark, sf, docs, monkeypatch):
    benchmark = table(spark, sf, "benchmark")
    whole = by_row(decontaminate.contaminated(docs, benchmark))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert by_row(decontaminate.contaminated(docs, benchmark)) == whole
    plain_words = lambda t: b" ".join(decontaminate.words_of(t))
    for i, t in [(r["item_id"], plain_words(r["text"])) for r in benchmark.collect()]:
        for r in docs.select("doc_id", "text").collect():
            if b" " + t + b" " in b" " + plain_words(r["text"]) + b" ":
                assert any(x[0] == r["doc_id"] and x[1] == i for x in whole)


def edited_copy(rng, words, edits, kinds):
    """The words with about ``edits`` spread substitutions, deletions or insertions."""
    out = list(words)
    for at in sorted(rng.choice(np.arange(1, len(words) - 1), min(edits, len(words) - 2), replace=False).tolist(), reverse=True):
        kind = kinds[int(rng.integers(len(kinds)))]
        out[at : at + (kind != "in")] = [] if kind == "out" else [f"new{rng.integers(1000)}"]
    return out


def test_decontamination_finds_all_that_alignment_finds(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(400)]
    items = {k: [vocabulary[w] for w in rng.integers(400, size=n)] for k, n in enumerate([15] * 8 + [5, 6, 20, 31, 50])}
    noise = lambda n: [vocabulary[w] for w in rng.integers(400, size=n)]
    texts = []
    for words in items.values():
        texts.append(noise(20) + words + noise(20))  # an exact copy makes the edited copies' n-grams look common
        for edits in (1, 2, 3, len(words) // 5):
            texts += [noise(20) + edited_copy(rng, words, edits, kinds) + noise(20) for kinds in (["sub"], ["out"], ["in"], ["sub", "out", "in"])]
    texts.append([w for k, w in enumerate(items[8]) if k != 2])
    items[99] = [f"u{k}" for k in range(15)]  # deletions and insertions in turn leave no three words together
    texts.append([x for k, w in enumerate(items[99]) for x in ([] if k in (2, 7, 12) else ["in", w] if k in (5, 10) else [w])])
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    ids: dict = {}
    number = lambda words: np.array([ids.setdefault(w, len(ids)) for w in words])
    want = set()
    for d, t in enumerate(texts):
        for i, words in items.items():
            _, matched, _, b, e = decontaminate.align(number(words), number(t))
            if matched >= 0.8 * len(words) and matched >= 0.8 * (e - b):
                want.add((d, i))
    assert len(want) > 150
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert want <= got and len(got) <= len(want) + 2
    assert {r[0] for r in decontaminate.drop_contaminated(df, bench).select("doc_id").collect()} == set(range(len(texts))) - {d for d, _ in got}


# pipeline


@pytest.mark.parametrize("counted", [0, 20_000])
def test_near_dedup_stage_drops_all_similar_texts(spark, edge, docs, sf, counted, monkeypatch):
    monkeypatch.setattr(near_dedup, "SAMPLE_ROWS", counted)
    rng = np.random.default_rng(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for k, edits in enumerate([1, 2, 3, 4, 5, 6, 7, 8] * 6):
        words = [f"n{w}" for w in rng.integers(500, size=200)]
        rows += [(10**6 + 2 * k, " ".join(words)), (10**6 + 2 * k + 1, " ".join(edited_copy(rng, words, edits, ["sub", "out", "in"])))]
    rows.append((rows[0][0], "another text of a repeated id that nothing else is like"))
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    holders: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < k).items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8:
                a, b = root(k), root(j)
                group[max(a, b)] = min(a, b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    want = sorted(r for k, r in enumerate(rows) if r[0] == least[root(k)])
    assert 20 < len(rows) - len(want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, df, sf).collect())) == want
    assert near_dedup.drop_near_duplicates(edge).columns == edge.columns
    assert near_dedup.drop_near_duplicates(edge.limit(0)).count() == 0


def kept_by(name, rows, index, benchmark):
    """The (id, text) rows that a stage must keep, by the plain rules."""
    ids: dict = {}
    number = lambda words: np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if name == "toxicity":
        return [r for r in rows if index.score(r[1])[0] < 0.7]
    if name == "exact_dedup":
        least: dict = {}
        for i, t in rows:
            least[plain(t)] = i if least.get(plain(t)) is None else min(i, least[plain(t)]) if i is not None else least[plain(t)]
        return [(i, t) for i, t in rows if i == least[plain(t)]]
    if name == "simhash_near_dedup":
        sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
        group = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if (same := len(sets[a] & sets[b])) and same / len(sets[a] | sets[b]) >= 0.8:
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
        least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in set(group)}
        return [r for r, g in zip(rows, group, strict=True) if r[0] == least[g]]

    def holds(text):
        words = decontaminate.words_of(text)
        for item in benchmark:
            for part in decontaminate.passages(decontaminate.words_of(item)):
                if len(set(part) & set(words)) < 0.5 * len(set(part)):
                    continue
                _, matched, _, b, e = decontaminate.align(number(part), number(words))
                if matched >= 0.8 * len(part) and matched >= 0.8 * (e - b):
                    return True
        return False

    return [r for r in rows if not holds(r[1])]


def test_pipeline_stages(spark, sf, docs, edge):
    """Each stage keeps the rows that plain rules keep of its own input; the last one decodes what it encodes."""
    labels, items = table(spark, sf, "labels"), [r["text"] for r in table(spark, sf, "benchmark").collect()]
    for begin in (docs, edge):
        before = begin
        for name, stage in corpus_pipeline.STAGES[:-1]:
            index = toxicity.fit(before, labels.where(~toxicity.held_out())) if name == "toxicity" else None
            after = stage(spark, before, sf)
            assert after.columns == begin.columns, name
            rows = sorted(map(tuple, before.select("doc_id", "text").collect()), key=repr)
            assert by_row(after.select("doc_id", "text")) == sorted(kept_by(name, rows, index, items), key=repr), name
            before = after.cache()
        last = corpus_pipeline.STAGES[-1][1](spark, before, sf)
        assert by_row(last.select("doc_id", "text")) == sorted(((r[0], r[1] or "") for r in before.select("doc_id", "text").collect()), key=repr)
        if begin is docs:
            final = corpus_pipeline.run(spark, sf)
            assert by_row(final.select("doc_id", "n_tokens")) == by_row(last.select("doc_id", "n_tokens"))
    empty = edge.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
