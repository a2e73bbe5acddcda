from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigrid.llm import decontaminate, lm_score, near_dedup, periodic_runs, queries, token_alignment, topk_search
from lexigrid.llm.common import table

A, B = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
#: Columns of any name stand beside those that an operator reads.
CLASHING = "id string, q string, v string, ids string, shard string, score string, rank string, n string, row string, rest string, pair string, runs string, groups string, words string"
TEXTS = [None, "", " ", " \t\n", "one", "a b  c", " lead", "trail ", "two  spaces\n\nlines\n x", "3.14, e.g. U.S.A., x²., y .z ,w", "▁mark ▁", "<|endoftext|> <s> </s> <unk>", "Ünïcödé ß 中文 🙂 ​", "tab\tend\x0b\x0c\r", "don't stop... can't!", "x" * 3000, "w " * 2000, "a b c " * 50, " nbsp  em", "ab" * 20 + " " + "é" * 600]


def clashing(spark, rows, ddl):
    return spark.createDataFrame([(*r, *["c"] * 14) for r in rows], f"{ddl}, {CLASHING}")


# 11


def brute_top_k(rows, k, asks):
    taken = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, q) in enumerate(taken):
        if asks(i):
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(taken) if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_of_all_rows(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(map(tuple, queries.op11_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, 5, lambda i: i % 50 == 0)


@pytest.mark.parametrize(("shard", "block"), [(16, 5), (64, 1000), (4096, 8192)])
def test_top_k_in_shards_and_blocks_with_ties_and_hot_vectors(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", block)
    rng = np.random.default_rng(shard)
    hot = [0.5, -0.25, 0.0, 0.125]
    rows = [(k, hot if k % 3 == 0 else [float(x) for x in rng.integers(-3, 4, 4) / 8]) for k in range(300)]
    rows += [(7, hot), (7, [1.0, 1.0, 1.0, 1.0]), (10, hot), (None, hot), (400, None), (401, [0.1, None, 0.2, 0.3]), (402, [math.nan, 0.0, 0.0, 0.0]), (403, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(410, []), (420, []), (430, [0.5]), (440, [0.0, 0.0, 0.0, 0.0]), (450, [3e38, 0.0, 0.0, 0.0])]
    df = clashing(spark, rows, "vec_id long, embedding array<float>")
    out = topk_search.top_k(df, F.col("vec_id") % 10 == 0, 5)
    want = brute_top_k([r for r in rows if r[0] != 450], 5, lambda i: i % 10 == 0)  # a product of that one leaves a long
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    df = spark.createDataFrame([(50, [0.5])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("wide", [1, 2, 8, 64])
def test_lists_are_read_until_outsiders_cannot_qualify(wide):
    rng = np.random.default_rng(wide)
    for n in (3, 40, 700):
        vectors = rng.integers(-200, 200, (n, wide)) if wide < 64 else np.floor(256 * rng.normal(size=(n, wide)) / 8).astype(np.int64)
        shard = topk_search.Shard(vectors, [[k] for k in range(n)])
        for own in range(0, n, max(1, n // 9)):
            scores = sorted((-int(vectors[own] @ vectors[k]), k) for k in range(n) if k != own)[:5]
            for bar in (-math.inf, float(-scores[-1][0])):
                assert [(-s, k) for s, k in shard.best(vectors[own], own, bar, 5)] == scores
    if wide == 64:
        assert len(shard.live(vectors[0], -float(scores[-1][0]), 5)) <= n * topk_search.FEW  # most are never scored


# 12


def brute_runs(words, least=6, repeats=4):
    found = []
    for q in range(1, len(words) // repeats + 1):
        at = 0
        while at + q < len(words):
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            run = (start, at + q - start, q)
            if run[1] >= max(least, repeats * q) and not any(all(words[k] == words[k + d] for k in range(start, start + run[1] - d)) for d in range(1, q)):
                found.append(run)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_run_row(doc_id, text):
    words = (text or "").encode().split()
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), s, n, q, None if q is None else 1000 * n // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_random_words():
    rng = np.random.default_rng(0)
    for k in range(4000):
        n = int(rng.integers(0, 70))
        words = rng.integers(0, rng.integers(1, 5), n)
        if k % 2 and n:
            a, p = int(rng.integers(0, n)), 1 + n // int(rng.integers(3, 11))
            words = words[a + np.arange(n - a) % p] if p <= n - a else words
        assert periodic_runs.runs_of(words) == brute_runs(words.tolist())


def test_runs_of_long_words_lists():
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert periodic_runs.runs_of(np.array(b)) == []  # no part of the Fibonacci word stands four times
    for n, p in ((200_000, 1), (200_000, 3), (100_000, 700), (100_000, 25_000)):
        assert periodic_runs.runs_of(np.arange(n) % p) == [(0, n, p)]
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(9, int), repeats=2)


def test_run_rows(spark, sf):
    short = table(spark, sf, "documents").where("length(text) < 3000")
    rows = [(r["doc_id"], r["text"]) for r in short.collect()]
    got = sorted(map(tuple, periodic_runs.run_digests(short).collect()))
    assert got == sorted(brute_run_row(*r) for r in rows) and sum(r[1] > 0 for r in got) > 9
    rows = [(k % 17, x) for k, x in enumerate(TEXTS)] + [(None, "a a a a a a a"), (None, None), (3, "one")]
    df = clashing(spark, rows, "doc_id long, text string")
    assert sorted(map(tuple, periodic_runs.run_digests(df).collect()), key=repr) == sorted((brute_run_row(*r) for r in rows), key=repr)
    assert periodic_runs.run_digests(df.limit(0)).count() == 0
    assert queries.op12_periodic_runs(spark, sf).count() == table(spark, sf, "documents").count()


def test_collapsed_texts(spark):
    df = clashing(spark, [(1, "x a b a b a b a b y"), (2, None), (2, "z z z z z z")], "doc_id long, text string")
    got = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in periodic_runs.periodic_runs(df).collect()}
    assert got == {(1, "x a b y"): [(1, 8, 2)], (2, ""): [], (2, "z"): [(0, 6, 1)]}


# 13


def brute_alignment(rows):
    """Both tokenizers over whole texts, links by overlapping byte ranges, groups by common ends."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    codec = token_alignment.Aligner(token_alignment.read_vocabulary(A), open(B, "rb").read())
    found, counts = [], Counter()
    for doc_id, text in rows:
        ia, ib = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba, bb = [codec.bytes_a[k] for k in ia], [codec.bytes_b[k] for k in ib]
        if not text or not b"".join(ba) == f" {text}".encode() == b"".join(bb):
            found.append((doc_id, None))
            continue
        ends_a, ends_b = np.cumsum([*map(len, ba)]).tolist(), np.cumsum([*map(len, bb)]).tolist()
        links, k = [], 0
        for j, end in enumerate(ends_b):
            start = end - len(bb[j])
            while k and ends_a[k - 1] > start:
                k -= 1
            while k < len(ia) and ends_a[k] - len(ba[k]) < end:
                if ends_a[k] > start:
                    links.append((ia[k], ib[j]))
                k += 1
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append(f"{','.join(map(str, ia[x:p]))}|{','.join(map(str, ib[y:q]))}")
            x, y = p, q
        counts.update(links)
        found.append((doc_id, (len(ia), len(ib), groups, links)))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [token_alignment.FREQUENT, 40, 0])
def test_alignment_of_all_documents(spark, sf, frequent):
    docs = table(spark, sf, "documents")
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = queries.op13_token_alignment(spark, sf) if frequent > 40 else token_alignment.align(docs, A, B, frequent=frequent)
    assert sorted(map(tuple, got.collect()), key=repr) == want


@pytest.mark.parametrize("units", [token_alignment.UNITS, 7])
def test_alignment_of_odd_texts(spark, monkeypatch, units):
    monkeypatch.setattr(token_alignment, "UNITS", units)
    rows = [*enumerate(TEXTS), (3, "one"), (None, "one two"), (None, None)]
    df = clashing(spark, rows, "doc_id long, text string")
    got = token_alignment.align(df, A, B)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_alignment(rows)
    assert token_alignment.align(df.limit(0), A, B).count() == 0
    rebuilt = token_alignment.align(df, A, B, written=True).where("groups <> ''").select("groups", "groups_sha256").first()
    assert hashlib.sha256(rebuilt[0].encode()).hexdigest() == rebuilt[1]


# near-dedup of the pipeline


@pytest.mark.parametrize("central", [1, 4])
def test_a_large_group_needs_few_pairs_and_loses_no_link(spark, monkeypatch, central):
    """Copies of copies, each like the one before only, beside many copies of one text and texts that share a passage."""
    monkeypatch.setattr(near_dedup, "CENTRAL", central)
    rng = np.random.default_rng(5)

    def changed(words, n):
        words = list(words)
        for at in rng.choice(len(words), n, replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        return words

    base = [f"w{k}" for k in range(150)]
    texts = [base, *[changed(base, int(rng.integers(1, 6))) for _ in range(120)]]
    chain = [[f"c{k}" for k in range(120)]]
    for _ in range(25):
        chain.append(changed(chain[-1], 2))
    passage = [f"p{k}" for k in range(60)]
    texts += chain + [[f"q{j}-{k}" for k in range(25)] + passage for j in range(30)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    group, pairs = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                pairs += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    asked = []
    verified = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda *a: asked.append(a[3].count()) or verified(*a))
    got = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(df).collect())
    assert got == [k for k, g in enumerate(group) if k == g]
    assert len(asked) == 2 and (central == 1 or sum(asked) < pairs / 3)


# decontamination


def test_a_passage_that_all_items_share_takes_bounded_memory():
    """2000 items with one passage in common, and a text that repeats it and holds one item."""
    import tracemalloc

    common = [f"c{k}" for k in range(11)]
    items = [(k, " ".join([*common, *[f"i{k}x{j}" for j in range(20)]])) for k in range(2000)]
    text = " ".join([*common * 150, *[f"t{k}" for k in range(3000)], items[7][1], *common * 150])
    block = decontaminate.Items(items)
    codes = block.codes(block.of_text(text), decontaminate.SEED)
    found = np.unique(codes[codes > 0], return_counts=True)
    find = decontaminate.finder(block, decontaminate.seeds_of(block, dict(zip(*map(np.ndarray.tolist, found), strict=True))), 0.8)
    tracemalloc.start()
    got = find(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[:3] for x in got] == [(7, 1.0, 31)]
    assert peak < 40 << 20


# language model


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, sf, monkeypatch):
    monkeypatch.setattr(lm_score, "TASK_WINDOWS", 60)
    docs = table(spark, sf, "documents")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1))  # copies of windows, too
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n, dealt in ((4, docs.coalesce(1)), (9, docs.repartition(7).orderBy(F.rand(3)))):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = lm_score.score_corpus(lm_score.cut(dealt.select("doc_id", "text")), queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")).collect()
        found.append(sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == docs.count()
