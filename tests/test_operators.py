from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import labels as L
from lexigrid.functions import text as X
from lexigrid.operators import convert as V
from lexigrid.operators import corpus as C
from lexigrid.operators import gating as G
from lexigrid.operators import metrics as M
from lexigrid.operators import sampling as S
from lexigrid.operators import sequences as Q
from lexigrid.operators import spans as P
from lexigrid.sources import readers as R
from lexigrid.sources import sinks as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("form", "pos", "label"), [("sg n", "S", "sg n_S"), ("", "S", "S"), ("da", "", "da"), ("", "", "_"), (None, None, "_")])
def test_compose(spark, form, pos, label):
    assert one(spark, L.compose(F.lit(form).cast("string"), F.lit(pos).cast("string"))) == label


@pytest.mark.parametrize(("label", "form", "pos"), [("sg n_S", "sg n", "S"), ("S", "", "S"), ("?", "?", ""), ("da", "da", ""), ("neg o_V", "neg o", "V")])
def test_decompose(spark, label, form, pos):
    assert tuple(one(spark, L.decompose(F.lit(label)))) == (form, pos)


@pytest.mark.parametrize(("label", "want"), [("pl all_S", "pl all_S"), ("pl all", "adt"), ("sg ill", "adt"), ("b", "b"), (None, None)])
def test_lenient(spark, label, want):
    assert one(spark, L.lenient(F.lit(label).cast("string"))) == want


def test_other_and_number_case(spark):
    assert one(spark, L.other(F.lit("b"))) == "other"
    assert one(spark, L.other(F.lit(None).cast("string"))) == "other"
    assert tuple(one(spark, L.number_case(F.lit("adt")))) == (None, "adt")
    assert one(spark, L.number_case(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("label", "want"), [("-", True), ("none", True), (" NONE ", True), ("", True), (None, True), ("D", False)])
def test_placeholders(spark, label, want):
    assert one(spark, L.is_placeholder(F.lit(label).cast("string"))) is want


def test_parse_placeholders_and_true_labels(spark):
    assert L.parse_placeholders("x, -") == ("-", "X")
    assert L.parse_placeholders(" ") == ("-", "NONE")
    assert one(spark, L.normalise_true(F.lit("['sg n']"))) == "sg n"
    assert one(spark, L.normalise_true(F.lit(None).cast("string"))) == "missing_true_label"


def test_feature_map_keeps_the_last_of_a_key(spark):
    assert one(spark, X.feature_map(F.lit("A=1|bad|B=2|A=3"))) == {"B": "2", "A": "3"}
    assert one(spark, X.feature_map(F.lit(None).cast("string"))) == {}


def test_lemma_and_pick_file(spark):
    assert one(spark, X.clean_lemma(F.lit("üle=minek=1"))) == "üleminek=1"
    assert tuple(one(spark, X.pick_file(F.lit("infl_type_17_randomly_picked_1000_sentences.jl")))) == (17, 1000, 1)
    assert tuple(one(spark, X.pick_file(F.lit("infl_type_17_randomly_picked_1000_sentences_pick_2.jl")))) == (17, 1000, 2)


def test_pack_sizes():
    assert S.pack_sizes({100: 1, 200: 1, 300: 1}, 300) == S.Packing(0, 1, 300, {300: (1, 0)})
    assert S.pack_sizes({50: 1, 80: 1, 120: 1, 40: 1}, 200) == S.Packing(0, 2, 200, {120: (0, 1), 80: (1, 0)})
    assert S.pack_sizes({}, 10) == S.pack_sizes({0: 3}, 10) == S.Packing(0, 0, 0, {})
    assert S.pack_sizes({3: 1}, 7) == S.Packing(2, 3, 9, {3: (1, 0)})
    assert S.pack_sizes({7: 10**12, 5: 1}, 7 * 10**12 - 1).items == 10**12 + 1  # one step a size, not one an item


def words_table(spark, sizes):
    rows = [(s, i, "t", k, f"w{k}") for (s, i), n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "source string, sentence_id long, type string, pos int, word string")


def test_sample_by_sentence_and_source(spark):
    rows = words_table(spark, {("s1", 1): 3, ("s1", 2): 2, ("s2", 3): 4})
    got, report = S.sample_corpus(rows, 4, "sentence")
    assert got.count() == 4 == report["achieved"]
    assert {r["source"] for r in got.collect()} == {"s2"}
    rows = words_table(spark, {("s1", 1): 5, ("s2", 2): 3})
    got, report = S.sample_corpus(rows, 4, "source")
    assert got.count() == 8 == report["achieved"]


def test_duplicate_flags_only_later_rows(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "c")], "ord int, text string")
    assert [r["duplicated"] for r in C.flag_duplicates(df).orderBy("ord").collect()] == [False, True, False]


def test_stratified_split_bounds(spark):
    rows = [("a", 0)] + [("b", k) for k in range(2)] + [("c", k) for k in range(10)]
    df = spark.createDataFrame(rows, "stratum string, key int")
    n = {r["stratum"]: r["n"] for r in S.stratified_split(df, ["stratum"], "key", 0.25, 1).where("split = 'test'").groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert n == {"b": 1, "c": 2}
    assert S.stratified_split(df, ["stratum"], "key", 0.0, 1).where("split = 'test'").count() == 0
    with pytest.raises(ValueError):
        S.stratified_split(df, ["stratum"], "key", 1.0, 1)


def test_metrics_with_a_predicted_only_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "-")], "true_label string, pred_label string")
    r = M.report(df).first()
    assert (r["rows"], r["labels"], r["accuracy"]) == (3, 3, 0.666667)
    assert r["macro_f1"] == round((2 / 3 + 0 + 1) / 3, 6)
    assert M.report(df.limit(0)).first()["labels"] == 0
    wide = M.confusion_matrix(df).orderBy("t").toPandas()
    assert list(wide.columns) == ["t", "-", "a", "b"]


def test_gate(spark):
    rows = words_table(spark, {("s", 1): 2})
    known = spark.createDataFrame([("W0",)], "word string")
    assert [r["answers"] for r in G.gate_words(rows, known, 0.5).collect()] == ["expert", "expert"]
    assert sorted(r["answers"] for r in G.gate_words(rows, known, 0.6).collect()) == ["baseline", "expert"]
    with pytest.raises(ValueError):
        G.gate_words(rows, known, 1.5)
    assert G.gate_stats(rows.limit(0), known).first()["expert_share"] == 0.0


def test_votes_and_ties(spark):
    df = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "c", 1.0)], "id int, label string, w double")
    assert {r["id"]: r["pred_label"] for r in G.votes(df, "id", "label", "w").collect()} == {1: "a", 2: "c"}
    assert G.most_common(df, "id", "label").count() == 2


def test_chunks():
    assert P.chunk_spans("") == []
    assert P.chunk_spans("x" * 999) == [(0, 999)]
    assert P.chunk_spans("x" * 1001) == [(0, 1000), (1000, 1001)]
    text = "a" * 600 + ". " + "b" * 600 + ". tail"
    assert [text[s:e] for s, e in P.chunk_spans(text)] == ["a" * 600 + ".", "b" * 600 + ".", "tail"]


def test_offsets_and_alignment():
    assert P.piece_offsets("Tere maailm", ["<s>", "▁Te", "re", "▁maailm"]) == [None, (0, 2), (2, 4), (5, 11)]
    a, b = {"f": "n", "p": "S"}, {"f": "g", "p": "S"}
    assert P.align_annotations([a], [a]) == [("COMMON", a, a)]
    assert P.align_annotations([a], [b]) == [("MODIFIED", a, b)]
    c = {"f": "x", "p": "V"}
    assert [x[0] for x in P.align_annotations([a], [c])] == ["MISSING", "EXTRA"]
    assert [x[0] for x in P.align_annotations([a, b], [b])] == ["COMMON", "MISSING"]


def test_align_layers(spark):
    old = spark.createDataFrame([(1, {"f": "n"})], "k int, ann map<string,string>")
    new = spark.createDataFrame([(1, {"f": "n"}), (2, {"f": "g"})], "k int, ann map<string,string>")
    assert {(r["k"], r["status"]) for r in P.align_layers(old, new, ["k"]).collect()} == {(1, "COMMON"), (2, "EXTRA")}


def test_treebank_conversion(spark):
    df = spark.createDataFrame(
        [("VERB", "V", "ei", "VerbForm=Inf"), ("AUX", "V", "ei", "Polarity=Neg"), ("NOUN", "S", "maja", "Case=Add|Number=Sing"), ("NOUN", "S", "maja", "Case=Dat|Number=Plur"), ("VERB", "V", "x", "Mood=Cnd|Tense=Pres|Voice=Act"), ("PROPN", "S", "x", "")],
        "upostag string, xpostag string, lemma string, f string",
    )
    got = V.reduced(df.withColumn("feats", X.feature_map(F.col("f")))).collect()
    assert [r["form"] for r in got] == ["da", "neg", "adt", "pl all", "ks", ""]
    assert got[-1]["pos"] == "H"
    bad = df.limit(1).withColumn("feats", X.feature_map(F.lit("Case=Zzz|Number=Sing")))
    with pytest.raises(Exception, match="unknown case"):
        V.reduced(bad).collect()
    fixed = V.corrected(spark.createDataFrame([("CCONJ", None, "ja", None), ("ADJ", "N", "5.", {"NumType": "Ord"}), ("VERB", "V", "tegema", {})], "upostag string, xpostag string, lemma string, feats map<string,string>")).collect()
    assert [(r["upostag"], r["xpostag"], r["lemma"]) for r in fixed] == [("CCONJ", "J", "ja"), ("NUM", "O", "5."), ("VERB", "V", "tege")]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# s\n1\tTere\ttere\tINTJ\tI\t_\t0\troot\t_\t_\n2\t!\t!\tPUNCT\t_\t_\t1\tpunct\t_\t_\n\n1\tX\tx\tX\tY\tA=1\t0\troot\t_\t_\n")
    rows = R.read_conllu(spark, str(tmp_path / "a.conllu")).orderBy("sentence", "position").collect()
    assert [(r["sentence"], r["text"], r["xpostag"]) for r in rows] == [(0, "Tere", "I"), (0, "!", None), (1, "X", "Y")]
    assert R.find_missing_xpos(spark, str(tmp_path / "a.conllu")).count() == 1
    (tmp_path / "c.jl").write_text('{"text": "a"}\n\n{"text": "b"}\n')
    assert [(r["sentence_no"], r["text"]) for r in R.read_json_lines(spark, str(tmp_path / "c.jl")).orderBy("sentence_no").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "l.csv").write_text("lemma,inflect_type,pos,case,form\nNA,19|2,S,,NULL\n")
    assert tuple(R.read_lexicon(spark, str(tmp_path / "l.csv")).first()) == ("NA", "19", "S", "", "NULL")
    (tmp_path / "w.txt").write_text("Tere\n\n tere \n")
    assert R.read_word_list(spark, str(tmp_path / "w.txt")).count() == 1
    (tmp_path / "v.json").write_text(json.dumps(["a", "b"]))
    assert R.read_vocabulary(spark, str(tmp_path / "v.json")).count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"text": "ab", "meta": {}, "layers": [{"name": "m", "spans": [{"start": 0, "end": 2, "annotations": [{"f": "n"}]}]}]}))
    assert R.read_annotated(spark, str(tmp_path / "d.json"), "m").count() == 1
    assert R.read_annotated(spark, str(tmp_path / "d.json"), "other").count() == 0
    with pytest.raises(FileNotFoundError):
        R.load_table(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError):
        R.load_table(spark, str(tmp_path / "no.xyz"))
    with pytest.raises(ValueError):
        R.require_columns(spark.range(1), ["words"])
    path = str(tmp_path / "results.json")
    new = spark.createDataFrame([("m", "s", 0.5, 0.5, 0.5, 0.5)], "model_name string, set_name string, accuracy double, precision double, recall double, `f1-score` double")
    K.upsert_results(spark, path, new)
    K.upsert_results(spark, path, new.withColumn("accuracy", F.lit(0.75)))
    assert [r["accuracy"] for r in R.read_results(spark, path).collect()] == [0.75]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        R.read_results(spark, str(tmp_path / "bad.json"))
    out = str(tmp_path / "per_source")
    K.write_new_sources(spark.createDataFrame([("a", 1)], "source string, x int"), out)
    K.write_new_sources(spark.createDataFrame([("a", 2), ("b", 3)], "source string, x int"), out)
    assert {(r["source"], r["x"]) for r in spark.read.option("header", True).csv(out).collect()} == {("a", "1"), ("b", "3")}
    tasks, view = K.label_tasks(spark.createDataFrame([("ab cd", "CD", 3, 5)], "text string, word string, start int, end int"), ["sg n"])
    assert json.loads(tasks.first()["value"])["data"]["start"] == 3
    assert "sg n" in view


def plain_treebank(text):
    """(sentence, position, word) by a plain walk over the whole file."""
    out, sentence = [], 0
    for block in re.split(r"\r?\n(?:[ \t]*\r?\n)+", text):
        lines = re.split(r"\r?\n", block)
        if not any(x[:1].isdigit() for x in lines):
            continue
        out += [(sentence, k, x.split("\t")[1]) for k, x in enumerate(y for y in lines if re.match(r"\d+\t", y))]
        sentence += 1
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_treebank_file_is_read_by_many_tasks(spark, tmp_path, end):
    import random

    r, parts = random.Random(3), []
    for s in range(400):
        block = [f"# sent_id = {s}"] * r.randint(0, 2)
        if r.random() < 0.9:
            block += [f"1-2\tab{s}\t_\t_"] * r.randint(0, 1) + [f"{k + 1}\tw{s}_{k}\tl\tNOUN\tS\t_\t0\troot\t_\t_" for k in range(r.choice([0, 1, 5, 40]))]
        parts.append(end.join(block + [""] * r.choice([1, 1, 2]) + ["  "] * r.randint(0, 1)))
    texts = {"a.conllu": end.join(parts), "b.conllu": end.join(parts[:50]), "c.conllu": "", "d.conllu": end * 3}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1k", "17k", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            rows = R.read_conllu(spark, str(tmp_path)).select("source", "sentence", "position", "text").collect()
            if size == "1k":
                assert spark.read.text(str(tmp_path / "a.conllu")).rdd.getNumPartitions() > 20
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        for name, text in texts.items():
            assert sorted(tuple(x)[1:] for x in rows if x["source"] == name) == plain_treebank(text), (name, size)


def plain_pack(items, target):
    """The packing rule on a plain list that is searched at every step."""
    everything = sorted((x for x in items if x[1] > 0), key=lambda x: x[1])
    pool, picked, rounds = list(everything), [], 0
    while sum(n for _, n in picked) < target and everything:
        if not pool:
            pool, rounds = list(everything), rounds + 1
        rest = target - sum(n for _, n in picked)
        exact = [x for x in pool if x[1] == rest]
        below = [x for x in pool if x[1] < rest]
        item = exact[0] if exact else below[-1] if below else pool[0]
        pool.remove(item)
        picked.append(item)
    return picked, sum(n for _, n in picked), rounds


def test_pack_like_the_plain_rule():
    import random
    from collections import Counter

    r = random.Random(5)
    for _ in range(10_000):
        items = [(f"s{k:02}", r.randint(0, 9)) for k in range(r.randint(0, 12))]
        target = r.choice((0, 1, r.randint(1, 40), 30, 150))
        got, (picked, total, rounds) = S.pack_sizes(Counter(n for _, n in items), target), plain_pack(items, target)
        assert (got.total, got.rounds, got.items) == (total, rounds, len(picked))
        of_size = {}
        for item in items:
            of_size.setdefault(item[1], []).append(item)
        if not rounds:
            chosen = {x for size, (a, z) in got.taken.items() for x in of_size[size][:a] + of_size[size][len(of_size[size]) - z :]}
            assert chosen == set(picked)


def plain_stratified(items, target):
    """(source, type, words) by name: quotas for the types in order of appearance, then the largest that are left."""
    kinds, chosen = list(dict.fromkeys(k for _, k, _ in items)), {}
    for n, kind in enumerate(kinds):
        own = [(s, w) for s, k, w in items if k == kind]
        share, odd = divmod(target, len(kinds))
        chosen |= dict(plain_pack(own, min(share + (n < odd), sum(w for _, w in own)))[0])
    for s, _, w in sorted((x for x in items if x[0] not in chosen), key=lambda x: (-x[2], x[0])):
        if sum(chosen.values()) >= target:
            break
        chosen[s] = w
    return chosen


def test_stratified_sources_like_the_plain_rule(spark):
    import random

    r = random.Random(7)
    for seed in range(4):
        items = [(f"s{k:02}", r.choice(["y", "x", None]), r.randint(1, 9)) for k in range(25)]
        rows = spark.createDataFrame([(s, 1, k, p) for s, k, n in items for p in range(n)], "source string, sentence_id long, type string, pos int")
        for target in (1, 20, 57, 90, 1000)[seed % 2 :: 2]:
            want = plain_stratified(items, target)
            got, report = S.sample_corpus(rows, target, "source", stratified=True)
            assert {x["source"]: x["count"] for x in got.groupBy("source").count().collect()} == want
            assert (report["achieved"], report["items"]) == (sum(want.values()), len(want))


def test_no_item_reaches_the_driver(spark):
    rows = spark.range(30_000).selectExpr("concat('s', id % 3000) source", "id sentence_id", "'t' type", "0 pos")
    rows = rows.unionByName(rows.withColumn("pos", F.lit(1)).where("sentence_id % 3 = 0"))
    seen = []
    collect = type(rows).collect
    try:
        type(rows).collect = lambda df: seen.append(got := collect(df)) or got
        S.sample_corpus(rows, 20_000, "source", stratified=True)
        S.sample_corpus(rows, 20_000, "sentence")
    finally:
        type(rows).collect = collect
    assert seen and max(map(len, seen)) < 20  # rows of distinct sizes and types only


def test_sentence_picks_are_those_of_the_plain_rule(spark):
    sizes = {(s, k): 1 + (3 * k + len(s)) % 6 for s in ("a", "bb") for k in range(12)}
    rows = spark.createDataFrame([(s, k, p, "t") for (s, k), n in sizes.items() for p in range(n)], "source string, sentence_id long, pos int, type string")
    for target in (1, 9, 40, 200):
        got, report = S.sample_corpus(rows, target, "sentence")
        picked, total, rounds = plain_pack(sorted(sizes.items()), target)
        assert {(r["source"], r["sentence_id"]) for r in got.collect()} == {k for k, _ in picked}
        assert (report["achieved"], report["rounds"], report["items"]) == (total, rounds, len(picked))


def test_first_by_hash_with_null_strata_and_bounds(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    for quota in (0, 1, 50, 1000):
        got = S.first_by_hash(df, ["g"], "id", 3, F.least(F.lit(quota), F.col("n"))).where("picked").groupBy("g").count().collect()
        sizes = {None: 134, 1: 133, 2: 133}
        assert {r["g"]: r["count"] for r in got} == ({g: min(quota, n) for g, n in sizes.items()} if quota else {})
    first = [r["id"] for r in df.orderBy(S.hashed(3, "id"), "id").limit(7).collect()]
    assert {r["id"] for r in S.first_by_hash(df, [], "id", 3, F.lit(7)).where("picked").collect()} == set(first)


def test_overlaps_across_bins(spark):
    import random

    r = random.Random(2)
    spans = lambda n: [(r.randint(0, 1), a := r.randint(0, 3000), a + r.choice([0, 1, 5, 700])) for _ in range(n)]
    w, b = sorted(set(spans(80))), sorted(set(spans(80)))
    want = sorted((k, a, z, x, y) for k, a, z in w for q, x, y in b if k == q and ((x < z < y) or (x <= z and a < y and y <= z)))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, start int, end int")
    assert sorted(map(tuple, P.overlaps(frame(w), frame(b)).collect())) == want
    points = spark.createDataFrame([(k, x) for k in (0, 1) for x in range(0, 3000, 37)], "doc_id int, x int")
    for p in P.token_at(frame(b), points).collect():
        hit = [(x, y) for q, x, y in b if q == p["doc_id"] and x <= p["x"] < y]
        assert (p["start"], p["end"]) == (min(hit) if hit else (None, None))


def test_verb_forms_last_rule_stands(spark):
    import itertools

    names = {"VerbForm": ("Inf", None), "Mood": ("Ind", "Cnd", None), "Tense": ("Pres", "Past"), "Voice": ("Act", "Pass"), "Person": ("1", "3", None), "Number": ("Sing", None), "Polarity": ("Neg", None)}
    rows, want = [], []
    for values in itertools.product(*names.values()):
        feats = {k: v for k, v in zip(names, values, strict=True) if v}
        form = "start"
        for polarity, conditions, x in V.VERB_FORMS:
            ok = {"neg": "Polarity" in feats, "aff": "Polarity" not in feats, "": True}[polarity]
            for c in conditions.split():
                ok = ok and c != "negaux" and (feats.get(c.split("=")[0], "-") == c.split("=")[1])
            form = x if ok else form
        rows.append((len(want), feats))
        want.append(form)
    df = spark.createDataFrame(rows, "k int, feats map<string,string>")
    got = df.select("k", V.verb_form(F.lit("VERB"), F.lit("V"), F.lit("x"), F.col("feats"), F.lit("start")).alias("f")).orderBy("k").collect()
    assert [r["f"] for r in got] == want
    with pytest.raises(Exception, match="number and case"):
        one(spark, V.verb_form(F.lit("VERB"), F.lit("V"), F.lit("x"), F.create_map(F.lit("Case"), F.lit("Nom"), F.lit("Number"), F.lit("Sing")), F.lit("")))


def test_offsets_by_word():
    pieces = lambda w: ["▁" + w[:2], *([w[2:]] if w[2:] else [])]
    text = "ab  cdef x"
    assert Q.offsets_by_word(text, ["▁ab", "▁cd", "ef", "▁x"], pieces) == [(0, 2), (4, 6), (6, 8), (9, 10)]
    assert Q.offsets_by_word("ab", ["zz"], lambda w: ["zz"]) == [(0, 2)]
    with pytest.raises(ValueError):
        Q.offsets_by_word(text, ["▁ab", "▁cd", "▁x"], pieces)
    with pytest.raises(ValueError):
        Q.offsets_by_word("ab", ["▁ab", "y"], pieces)


def test_sequences_are_cut_and_padded(spark):
    rows = spark.createDataFrame([(1, 0, "abcdef", "A"), (1, 1, "", "B"), (1, 2, "xy", "C"), (2, 0, None, None)], "s int, pos int, word string, label string")
    ids = spark.createDataFrame([("A", 0), ("B", 1)], "label string, id int")
    load = lambda: lambda w: [w[k : k + 2] for k in range(0, len(w), 2)]
    got = {r["s"]: (r["pieces"], r["label_ids"]) for r in Q.encode_words(rows, load, ids, ["s"], 6).collect()}
    assert got[1] == (["[CLS]", "ab", "cd", "ef", "[UNK]", "[SEP]"], [-100, 0, -100, -100, 1, -100])
    assert got[2] == (["[CLS]", "[UNK]", "[SEP]"], [-100, -100, -100])
    assert one(spark, Q.padded(F.array(F.lit("a")), 3, "p")) == ["a", "p", "p"]


def test_random_analyses_can_be_repeated(spark):
    words = spark.createDataFrame([(1, 0, 2), (1, 3, 4)], "d int, start int, end int")
    layer = spark.createDataFrame([(1, 0, 2, k, f"L{k}") for k in range(9)] + [(1, 3, 5, 0, "x")], "d int, start int, end int, ann int, label string")
    pick = lambda seed: [tuple(r) for r in Q.annotate_rows(words, layer, ["d"], pick="random", seed=seed).select("start", "pred_label", "analyses", "ambiguous").orderBy("start").collect()]
    assert pick(1) == pick(1) and len({tuple(pick(k)) for k in range(6)}) > 1
    assert pick(1)[1] == (3, None, 0, False) and pick(1)[0][2:] == (9, True)


def test_results_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "r.json")
    rows = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.25)], "model_name string, set_name string, accuracy double")
    K.upsert_results(spark, path, rows)
    K.upsert_results(spark, path, rows.limit(1).withColumn("accuracy", F.lit(1.0)))
    assert {(r["model_name"], r["accuracy"]) for r in R.read_results(spark, path).collect()} == {("a", 1.0), ("b", 0.25)}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r.json"]
    K.write_cost(spark, str(tmp_path / "c"), 1.5)
    assert K.read_cost(spark, str(tmp_path / "c")) == 1.5 and K.read_cost(spark, str(tmp_path / "none")) == 0


def test_json_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("a.jl", 400), ("b.jl", 3)):
        (tmp_path / name).write_text("".join(f'{{"text": "t{k}"}}\n' + "\n" * (k % 3) for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = R.read_json_lines(spark, str(tmp_path)).select(F.regexp_extract("file", "[^/]+$", 0).alias("f"), "sentence_no", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == sorted([("a.jl", k, f"t{k}") for k in range(400)] + [("b.jl", k, f"t{k}") for k in range(3)])
