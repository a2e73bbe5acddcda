"""Queries over the proxy tables, one for each operator or a few, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import labels as L
from lexigrid.functions import text as X
from lexigrid.operators import convert as V
from lexigrid.operators import corpus as C
from lexigrid.operators import gating as G
from lexigrid.operators import metrics as M
from lexigrid.operators import sampling as S
from lexigrid.operators import spans as P
from lexigrid.sources.sinks import upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SPLIT = r"string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ')"
W = f"""w AS (SELECT * FROM (SELECT doc_id AS sentence_id, source, lang AS type, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
      FROM (SELECT *, {SPLIT} AS ws FROM documents)) WHERE word <> '')"""
H = f"h AS (SELECT DISTINCT word FROM (SELECT lower(unnest({SPLIT})) AS word FROM benchmark) WHERE word <> '')"
D = f"d AS (SELECT source, sentence_id, count(*) AS n, count(h.word) AS hits, avg(CASE WHEN h.word IS NULL THEN 0.0 ELSE 1.0 END) AS density FROM w LEFT JOIN h ON lower(w.word) = h.word GROUP BY ALL)"
JUDGED = "j AS (SELECT doc_id, source, lang, cast(quality AS VARCHAR) AS t, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars % 3 = 0 THEN '0' ELSE '1' END AS p FROM documents JOIN labels USING (doc_id))"
PARTS = "e AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'sg n' WHEN 2 THEN 'pl all' WHEN 3 THEN 'sg ill' ELSE 'b' END AS form, CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'S' WHEN 2 THEN 'V' ELSE 'H' END AS pos FROM lineitem)"
COMPOSED = "c AS (SELECT *, CASE WHEN form <> '' AND pos <> '' THEN form || '_' || pos WHEN pos <> '' THEN pos WHEN form <> '' THEN form ELSE '_' END AS label FROM e)"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(spark: SparkSession, sf: str) -> DataFrame:
    return C.word_rows(t(spark, sf, "documents"))


def homonyms(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.word_rows(t(spark, sf, "benchmark").withColumns({"source": F.lit("b"), "lang": F.lit("b")}), "item_id")
    return rows.select(F.lower("word").alias("word")).distinct()


def judged(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "source", "lang", F.col("quality").cast("string").alias("true_label"), F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") % 3 == 0, "0").otherwise("1").alias("pred_label"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    li = t(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), pick(F.col("l_suppkey") % 5, ["", "sg n", "pl all", "sg ill", "b"]).alias("form"), pick(F.col("l_partkey") % 4, ["", "S", "V", "H"]).alias("pos"))


def composed(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).withColumn("label", L.compose(F.col("form"), F.col("pos")))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"WITH {W} SELECT type, count(*) AS n, count(DISTINCT lower(word)) AS distinct_words FROM w GROUP BY type")
def word_rows_count(s, sf):
    return words(s, sf).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct(F.lower("word")).alias("distinct_words"))


@query(f"WITH {W} SELECT source, sentence_id, count(*) AS size FROM w GROUP BY ALL")
def sentence_sizes(s, sf):
    return C.sentence_sizes(words(s, sf))


@query(f"WITH {W}, o AS (SELECT source, sentence_id, count(*) AS size, min(type) AS type FROM w GROUP BY ALL) SELECT source, cast(sum(size) AS BIGINT) AS words, count(*) AS sentences, arg_min(type, sentence_id) AS first_type FROM o GROUP BY source")
def source_sizes(s, sf):
    return C.source_sizes(words(s, sf))


@query(f"WITH {W} SELECT source, sentence_id, md5(string_agg(word, ' ' ORDER BY pos)) AS digest, count(*) AS n FROM w GROUP BY ALL")
def sentence_arrays(s, sf):
    return C.sentences(words(s, sf)).select("source", "sentence_id", F.md5(F.col("sentence").cast("binary")).alias("digest"), F.size("words").cast("long").alias("n"))


@query("SELECT page_id, CASE WHEN n LIKE 'blog.%' THEN 'blogs' WHEN n LIKE 'm.%' THEN 'mobile' ELSE 'unknown' END AS type FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS n FROM pages)")
def type_inference(s, sf):
    name = F.regexp_replace("url", "^https?://", "")
    return t(s, sf, "pages").select("page_id", X.type_from_name(name, prefixes=(("blog.", "blogs"), ("m.", "mobile"))).alias("type"))


@query(f"WITH {PARTS}, {COMPOSED} SELECT label, count(*) AS n FROM c GROUP BY label")
def label_compose(s, sf):
    return composed(s, sf).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS}, {COMPOSED}, x AS (SELECT string_split(label, '_') AS p FROM c)
SELECT CASE WHEN len(p) = 1 AND upper(p[1]) = p[1] AND lower(p[1]) <> p[1] THEN '' ELSE p[1] END AS form,
       CASE WHEN len(p) > 1 THEN p[2] WHEN upper(p[1]) = p[1] AND lower(p[1]) <> p[1] THEN p[1] ELSE '' END AS pos, count(*) AS n FROM x GROUP BY ALL""")
def label_decompose(s, sf):
    return composed(s, sf).select(L.decompose(F.col("label")).alias("x")).groupBy("x.form", "x.pos").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS}, {COMPOSED}, x AS (SELECT split_part(label, '_', 1) AS f, count(*) AS n FROM c GROUP BY 1),
y AS (SELECT f, n, CASE WHEN regexp_matches(f, '\\b(ill|all)\\b') THEN 'adt' ELSE f END AS lenient FROM x)
SELECT f, n, lenient, CASE WHEN regexp_matches(lenient, '\\b(n|g|p|adt)\\b') THEN lenient ELSE 'other' END AS other,
CASE WHEN contains(f, ' ') THEN split_part(f, ' ', 1) END AS number, CASE WHEN contains(f, ' ') THEN substr(f, instr(f, ' ') + 1) ELSE f END AS cas FROM y""")
def lenient_other(s, sf):
    x = composed(s, sf).groupBy(L.form_of(F.col("label")).alias("f")).agg(F.count("*").alias("n"))
    x = x.withColumn("lenient", L.lenient(F.col("f"))).withColumn("other", L.other(F.col("lenient")))
    return x.select("f", "n", "lenient", "other", L.number_case(F.col("f"))["number"].alias("number"), L.number_case(F.col("f"))["case"].alias("cas"))


@query(f"WITH {PARTS}, x AS (SELECT CASE WHEN pos = '' THEN ' none ' WHEN pos = 'V' THEN '-' ELSE pos END AS v FROM e) SELECT CASE WHEN trim(v) = '' OR upper(trim(v)) IN ('-', 'NONE') THEN '-' ELSE v END AS label, count(*) AS n FROM x GROUP BY 1")
def placeholder_normalise(s, sf):
    v = F.when(F.col("pos") == "", " none ").when(F.col("pos") == "V", "-").otherwise(F.col("pos"))
    return parts(s, sf).groupBy(L.normalise_placeholder(v).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source, doc_id) - 1 AS gid FROM documents")
def global_sentence_id(s, sf):
    return C.dense_ids(t(s, sf, "documents").select("doc_id", "source"), ["source", "doc_id"], "gid")


@query("WITH f AS (SELECT source, min(doc_id) AS o FROM documents GROUP BY 1), r AS (SELECT source, row_number() OVER (ORDER BY o, source) - 1 AS sid FROM f) SELECT doc_id, source, sid FROM documents JOIN r USING (source)")
def first_seen_id(s, sf):
    return C.dense_ids(t(s, sf, "documents").select("doc_id", "source"), ["source"], "sid", F.col("doc_id"))


@query("SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicated FROM documents")
def duplicate_flag(s, sf):
    return C.flag_duplicates(t(s, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text")), "text", "doc_id").select("doc_id", "duplicated")


@query("WITH f AS (SELECT source, n_chars, doc_id > min(doc_id) OVER (PARTITION BY text) AS d FROM documents) SELECT source, count(*) AS rows_n, count(*) FILTER (d) AS duplicated, cast(sum(n_chars) AS BIGINT) AS chars FROM f GROUP BY source")
def dedup_report(s, sf):
    f = C.flag_duplicates(t(s, sf, "documents").select("source", "n_chars", "doc_id", F.md5(F.col("text").cast("binary")).alias("text")), "text", "doc_id")
    return f.groupBy("source").agg(F.count("*").alias("rows_n"), F.count_if("duplicated").alias("duplicated"), F.sum("n_chars").alias("chars"))


@query(f"WITH {W}, {H} SELECT lower(w.word) AS label, count(*) AS n FROM w WHERE lower(w.word) NOT IN (SELECT word FROM h) GROUP BY 1")
def vocabulary_unknown(s, sf):
    return L.unknown_labels(words(s, sf).select(F.lower("word").alias("label")), homonyms(s, sf).withColumnRenamed("word", "label"))


@query("""WITH a AS (SELECT n_name AS label, max(n_nationkey) AS id_a FROM nation WHERE n_nationkey < 20 GROUP BY 1), b AS (SELECT n_name AS label, max(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 100 ELSE n_nationkey END) AS id_b FROM nation WHERE n_nationkey > 5 GROUP BY 1)
SELECT coalesce(a.label, b.label) AS label, coalesce(id_a, -1) AS id_a, coalesce(id_b, -1) AS id_b, CASE WHEN id_b IS NULL THEN 'only_a' WHEN id_a IS NULL THEN 'only_b' WHEN id_a <> id_b THEN 'id_mismatch' ELSE 'same' END AS status FROM a FULL JOIN b ON a.label = b.label""")
def label_set_diff(s, sf):
    n = t(s, sf, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("id"))
    both = L.compare_vocabularies(n.where("id < 20"), n.where("id > 5").withColumn("id", F.when(F.col("id") % 3 == 0, F.col("id") + 100).otherwise(F.col("id"))))
    return both.na.fill(-1, ["id_a", "id_b"])


@query("""WITH f AS (SELECT DISTINCT event_type AS form FROM events), p AS (SELECT DISTINCT upper(c_mktsegment) AS pos FROM customer)
SELECT label, count(*) AS n FROM (SELECT form || '_' || pos AS label FROM f, p UNION ALL SELECT pos FROM p UNION ALL SELECT form FROM f UNION ALL SELECT '?_' || pos FROM p) GROUP BY label""")
def label_space(s, sf):
    return L.vocabulary(t(s, sf, "events").select("event_type").distinct(), t(s, sf, "customer").select(F.upper("c_mktsegment")).distinct()).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {W}, {H}, {D} SELECT source, sentence_id, n AS words, hits, round(density, 6) AS density FROM d")
def homonym_density(s, sf):
    return G.density(words(s, sf), homonyms(s, sf))


@query(f"""WITH {W}, {H}, {D} SELECT w.source, w.sentence_id, count(*) FILTER (density >= 0.02 OR h.word IS NOT NULL) AS expert, count(*) FILTER (NOT (density >= 0.02 OR h.word IS NOT NULL)) AS baseline
FROM w JOIN d ON w.source = d.source AND w.sentence_id = d.sentence_id LEFT JOIN h ON lower(w.word) = h.word GROUP BY ALL""")
def gate_decisions(s, sf):
    g = G.gate_words(words(s, sf), homonyms(s, sf), 0.02)
    return g.groupBy("source", "sentence_id").agg(F.count_if(F.col("answers") == "expert").alias("expert"), F.count_if(F.col("answers") == "baseline").alias("baseline"))


@query(f"""WITH {W}, {H}, {D}, x AS (SELECT count(*) AS sentences, cast(sum(n) AS BIGINT) AS tokens, cast(sum(CASE WHEN density >= 1 THEN n ELSE hits END) AS BIGINT) AS expert, avg(density) AS m FROM d)
SELECT sentences, tokens, expert, cast(0 AS BIGINT) AS placeholder, tokens - expert AS baseline, round(m, 6) AS mean_density, round(expert / tokens, 6) AS expert_share FROM x""")
def gate_stats(s, sf):
    return G.gate_stats(words(s, sf), homonyms(s, sf))


CLASS = """k AS (SELECT {g}label, sum(s) AS support, sum(q) AS predicted, sum(b) AS tp FROM (SELECT {g}t AS label, 1 AS s, 0 AS q, (t = p)::INT AS b FROM j UNION ALL SELECT {g}p, 0, 1, 0 FROM j) GROUP BY ALL),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1 FROM k)"""
MEANS = """cast(sum(support) AS BIGINT) AS rows, count(*) AS labels, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1"""


@query(f"WITH {JUDGED}, {CLASS.format(g='')} SELECT label, cast(support AS BIGINT) AS support, cast(predicted AS BIGINT) AS predicted, cast(tp AS BIGINT) AS tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def per_class_report(s, sf):
    return M.per_class(judged(s, sf)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {JUDGED}, {CLASS.format(g='')} SELECT {MEANS} FROM m")
def classification_report(s, sf):
    return M.report(judged(s, sf))


@query(f"WITH {JUDGED}, {CLASS.format(g='lang, ')} SELECT lang AS grp, {MEANS} FROM m GROUP BY lang")
def grouped_report(s, sf):
    return M.report(judged(s, sf), group="lang")


@query(f"WITH {JUDGED}, c AS (SELECT t, p, count(*) AS n FROM j WHERE p IN (SELECT t FROM j) OR (SELECT count(*) FROM j x WHERE x.p = j.p) * 100.0 / (SELECT count(*) FROM j) >= 5 GROUP BY ALL) SELECT t, p, n, round(n / sum(n) OVER (PARTITION BY t), 6) AS share FROM c")
def confusion_matrix(s, sf):
    return M.confusion(judged(s, sf), least_percent=5)


@query(f"WITH {JUDGED} SELECT p, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM j), 2) AS percent, round(count(*) * 100.0 / (SELECT count(*) FROM j), 2) >= 5 AS included FROM j WHERE p NOT IN (SELECT t FROM j) GROUP BY p")
def predicted_only(s, sf):
    return M.predicted_only(judged(s, sf), least_percent=5)


@query(f"WITH {JUDGED}, a AS (SELECT t AS label, count(*) AS n FROM j GROUP BY 1), b AS (SELECT p AS label, count(*) AS n FROM j GROUP BY 1) SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS true_n, coalesce(b.n, 0) AS pred_n, coalesce(a.n, 0) + coalesce(b.n, 0) AS total FROM a FULL JOIN b ON a.label = b.label")
def label_distribution(s, sf):
    return M.distribution(judged(s, sf))


@query(f"WITH {JUDGED}, a AS (SELECT x AS label, count(*) AS total FROM (SELECT t AS x FROM j UNION ALL SELECT p FROM j) GROUP BY 1) SELECT label, total FROM a ORDER BY total DESC, label LIMIT 2")
def top_labels(s, sf):
    return M.distribution(judged(s, sf)).select("label", "total").orderBy(F.desc("total"), "label").limit(2)


@query(f"WITH {JUDGED}, x AS (SELECT t, p AS a, CASE WHEN doc_id % 4 = 0 THEN t ELSE '1' END AS b FROM j) SELECT count(*) AS rows, count(*) FILTER (a <> b) AS differ, count(*) FILTER (a <> b AND a = t) AS first_right, count(*) FILTER (a <> b AND b = t) AS second_right FROM x")
def model_disagreement(s, sf):
    return M.disagreement(judged(s, sf).withColumn("b", F.when(F.col("doc_id") % 4 == 0, F.col("true_label")).otherwise("1")), "true_label", "pred_label", "b")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n, round(n * 100.0 / sum(n) OVER (PARTITION BY user_id), 3) AS percent FROM c")
def percentage_per_group(s, sf):
    return C.share_in_group(t(s, sf, "events"), "user_id", "event_type")


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 3) AS percent FROM events GROUP BY 1")
def value_counts(s, sf):
    return C.value_counts(t(s, sf, "events"), "event_type")


@query(f"WITH {PARTS} SELECT pos, count(*) FILTER (form = '') AS empty, count(*) AS n FROM e GROUP BY pos")
def empty_form_per_pos(s, sf):
    return C.empty_per_group(parts(s, sf), "pos", "form")


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS pred_label FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def majority_baseline(s, sf):
    return S.majority_baseline(t(s, sf, "events"), "event_type", "user_id")


@query("SELECT event_id, ['x', 'y', 'z'][1 + cast(('0x' || substr(md5('3|' || event_id), 1, 8)) AS BIGINT) % 3] AS pred_label FROM events")
def uniform_baseline(s, sf):
    return S.uniform_baseline(t(s, sf, "events"), "event_id", ["x", "y", "z"], 3).select("event_id", "pred_label")


@query("SELECT doc_id, source, md5('7|' || source) AS block FROM documents")
def block_shuffle(s, sf):
    return S.block_shuffle(t(s, sf, "documents").select("doc_id", "source"), 7)


@query("WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5('5|' || source), source) AS k, count(*) OVER () AS n FROM s) SELECT source, CASE WHEN k <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM r")
def hash_split(s, sf):
    return S.split_sources(t(s, sf, "documents").select("source").distinct(), 0.2, 5)


@query("""WITH r AS (SELECT doc_id, lang, source, count(*) OVER w AS n, row_number() OVER (w ORDER BY md5('9|' || doc_id), doc_id) AS k FROM documents WINDOW w AS (PARTITION BY lang, source))
SELECT doc_id, CASE WHEN n >= 2 AND k <= least(greatest(round_even(n * 0.25, 0), 1), n - 1) THEN 'test' ELSE 'train' END AS split FROM r""".replace("OVER (w ORDER BY", "OVER (PARTITION BY lang, source ORDER BY"))
def stratified_split(s, sf):
    return S.stratified_split(t(s, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 0.25, 9).select("doc_id", "split")


@query(f"""WITH {W}, o AS (SELECT source, sentence_id, count(*) AS size, min(type) AS type FROM w GROUP BY ALL), z AS (SELECT source, sum(size) AS words, arg_min(type, sentence_id) AS first_type FROM o GROUP BY source),
b AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY first_type ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z) SELECT source, first_type, cast(words AS BIGINT) AS words FROM b WHERE before < 50000""")
def gather_n_per_type(s, sf):
    return S.gather_n_per_type(C.source_sizes(words(s, sf)), 50_000).select("source", "first_type", "words")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('1|' || doc_id), doc_id) <= 5")
def n_per_group(s, sf):
    return S.n_per_group(t(s, sf, "documents").select("doc_id", "lang"), 5, ["lang"], "doc_id").select("doc_id", "lang")


@query("SELECT doc_id FROM documents ORDER BY md5('4|' || doc_id), doc_id LIMIT 100")
def shuffle_and_take(s, sf):
    return S.take_hashed(t(s, sf, "documents").select("doc_id"), 100, "doc_id", 4)


@query("""WITH d AS (SELECT DISTINCT lang, md5(text) AS x FROM documents), o AS (SELECT lang, x FROM d QUALIFY row_number() OVER (PARTITION BY x ORDER BY md5('1|' || lang || '|' || x), lang) = 1)
SELECT lang, x FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('1|' || x), x) <= 10""")
def pick_per_type(s, sf):
    return S.pick_per_type(t(s, sf, "documents").select("lang", F.md5(F.col("text").cast("binary")).alias("x")), 10, 1, "lang", "x").select("lang", "x")


@query()
def stratified_source_sampler(s, sf):
    rows, _ = S.sample_corpus(words(s, sf), 100_000, "source", stratified=True)
    return rows.groupBy("source").agg(F.count("*").alias("words"))


@query()
def corpus_mix(s, sf):
    w = words(s, sf)
    rows, _ = S.mix_corpora({"a": w.where("type = 'en'"), "b": w.where("type = 'fr'"), "c": w.where("type = 'de'")}, 90_000, mode="source", stratified=("a",))
    return rows.groupBy("orig_corpus", "source").agg(F.count("*").alias("words"))


@query("""WITH x AS (SELECT lang, source, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)
SELECT lang, source, count(*) AS overall, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, round(count(*) FILTER (split = 'train') / count(*), 6) AS train_ratio, round(count(*) FILTER (split = 'test') / count(*), 6) AS test_ratio FROM x GROUP BY ALL""")
def split_counts_comparison(s, sf):
    return C.split_counts(t(s, sf, "documents").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")), ["lang", "source"], "split")


SPANS = f"sp AS (SELECT sentence_id, pos, cast(coalesce(sum(length(word) + 1) OVER (PARTITION BY source, sentence_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st, length(word) AS len FROM w)"
WINDOWS = "b AS (SELECT doc_id, unnest(range(0, n_chars, 40)) AS bs FROM documents)"


def _spans(s, sf):
    return P.word_spans(words(s, sf)).select(F.col("sentence_id").alias("doc_id"), "pos", "word", "start", "end")


def _windows(s, sf):
    d = t(s, sf, "documents").where("n_chars > 0")
    return d.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_chars") - 1, F.lit(40))).alias("start")).withColumn("end", F.col("start") + 40)


@query(f"""WITH {W}, {SPANS}, {WINDOWS} SELECT doc_id, count(*) AS pairs FROM sp JOIN b ON sp.sentence_id = b.doc_id
WHERE (bs < st + len AND st + len < bs + 40) OR (bs <= st + len AND st < bs + 40 AND bs + 40 <= st + len) GROUP BY doc_id""")
def overlap_join(s, sf):
    return P.overlaps(_spans(s, sf), _windows(s, sf)).groupBy("doc_id").agg(F.count("*").alias("pairs"))


@query(f"WITH {WINDOWS} SELECT d.doc_id, d.n_chars // 2 AS x, min(bs) AS start, min(bs) + 40 AS \"end\" FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id AND bs <= n_chars // 2 AND n_chars // 2 < bs + 40 GROUP BY ALL")
def point_in_span(s, sf):
    return P.token_at(_windows(s, sf), t(s, sf, "documents").select("doc_id", F.expr("n_chars div 2").alias("x")))


@query(f"""WITH {W}, {H}, c AS (SELECT source, sentence_id, pos, word, string_agg(word, ' ') OVER (PARTITION BY source, sentence_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS context FROM w)
SELECT sentence_id, pos, context FROM c WHERE lower(word) IN (SELECT word FROM h WHERE length(word) > 12)""")
def context_window(s, sf):
    known = homonyms(s, sf).where(F.length("word") > 12)
    return P.context(C.in_list(words(s, sf), known), F.col("hit")).select("sentence_id", F.col("pos").cast("long").alias("pos"), "context")


@query("""WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM a) SELECT user_id, min(event_id) AS start, max(event_id) AS "end", min(event_type) AS type, count(*) AS n FROM b GROUP BY user_id, island""")
def islands_merge(s, sf):
    from pyspark.sql import Window

    e = t(s, sf, "events").select("user_id", "event_id", "event_type")
    same = F.col("event_type") == F.col("prev")
    e = e.withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    return P.islands(e, same, ["user_id"], ["event_id"]).groupBy("user_id", "island").agg(F.min("event_id").alias("start"), F.max("event_id").alias("end"), F.min("event_type").alias("type"), F.count("*").alias("n")).drop("island")


@query("""WITH x AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'B-' WHEN 3 THEN 'O' ELSE 'I-' END AS b, event_type AS k FROM events),
y AS (SELECT *, CASE WHEN b = 'O' THEN 'O' ELSE k END AS kind FROM x), z AS (SELECT *, CASE WHEN b = 'I-' AND lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) = kind THEN 0 ELSE 1 END AS new FROM y),
q AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM z)
SELECT user_id, min(event_id) AS start, max(event_id) AS "end", min(kind) AS type, string_agg(cast(event_id AS VARCHAR), ' ' ORDER BY event_id) AS phrase FROM q WHERE b <> 'O' GROUP BY user_id, island""")
def merge_tags(s, sf):
    k = F.col("event_id") % 4
    tag = F.when(k == 0, F.concat(F.lit("B-"), "event_type")).when(k == 3, "O").otherwise(F.concat(F.lit("I-"), "event_type"))
    return P.merge_tags(t(s, sf, "events").select("user_id", "event_id", tag.alias("tag"), F.col("event_id").cast("string").alias("word")), ["user_id"], "event_id")


@query("""WITH a AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role AND lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 = turn THEN 0 ELSE 1 END AS new FROM conversations),
b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM a) SELECT conv_id, min(turn) AS start, max(turn) + 1 AS "end", min(role) AS type, repeat('x', cast(count(*) AS INT)) AS text FROM b GROUP BY conv_id, island""")
def adjacent_concat(s, sf):
    c = t(s, sf, "conversations").select("conv_id", F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.col("role").alias("type"), F.lit("x").alias("text"))
    return P.join_touching(c, ["conv_id"])


@query(f"WITH {W} SELECT sentence_id, pos, cast(1 + coalesce(sum(1 + length(word) // 4) OVER (PARTITION BY source, sentence_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pointer FROM w")
def subtoken_pointer(s, sf):
    r = words(s, sf).withColumn("n_tokens", F.expr("1 + length(word) div 4"))
    return P.subtoken_pointer(r, ["source", "sentence_id"]).select("sentence_id", F.col("pos").cast("long").alias("pos"), "pointer")


LAYERS = """o AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS form, l_linestatus AS pos FROM lineitem WHERE l_partkey % 11 <> 0),
nw AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_suppkey % 7 = 0 THEN 'X' ELSE l_returnflag END AS form, l_linestatus AS pos FROM lineitem WHERE l_partkey % 13 <> 0),
df AS (SELECT coalesce(o.k, nw.k) AS k, coalesce(o.n, nw.n) AS n, CASE WHEN nw.k IS NULL THEN 'MISSING' WHEN o.k IS NULL THEN 'EXTRA' WHEN o.form = nw.form AND o.pos = nw.pos THEN 'COMMON' ELSE 'MODIFIED' END AS status,
 CASE WHEN o.k IS NOT NULL AND nw.k IS NOT NULL THEN (o.form = nw.form)::INT + (o.pos = nw.pos)::INT ELSE 0 END AS same FROM o FULL JOIN nw ON o.k = nw.k AND o.n = nw.n)"""


def _diff(s, sf):
    li = t(s, sf, "lineitem")
    base = [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")]
    old = li.where("l_partkey % 11 <> 0").select(*base, F.col("l_returnflag").alias("form"), F.col("l_linestatus").alias("pos"))
    new = li.where("l_partkey % 13 <> 0").select(*base, F.when(F.col("l_suppkey") % 7 == 0, "X").otherwise(F.col("l_returnflag")).alias("form"), F.col("l_linestatus").alias("pos"))
    return P.layer_diff(old, new, ["k", "n"], ["form", "pos"])


@query(f"WITH {LAYERS} SELECT k, n, status, cast(same AS INT) AS same FROM df")
def layer_diff(s, sf):
    return _diff(s, sf).select("k", "n", "status", F.size("matching").alias("same"))


@query(f"""WITH {LAYERS}, g AS (SELECT cast(n AS VARCHAR) AS category, status FROM df UNION ALL SELECT 'TOTAL', status FROM df)
SELECT category, count(*) FILTER (status = 'COMMON') AS common_spans, count(*) FILTER (status = 'MODIFIED') AS modified_spans, count(*) FILTER (status = 'MISSING') AS missing_spans, count(*) FILTER (status = 'EXTRA') AS extra_spans, count(*) AS spans FROM g GROUP BY category""")
def diff_summary(s, sf):
    return P.diff_summary(_diff(s, sf), "n")


UD = """u AS (SELECT CASE l_partkey % 5 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'PROPN' WHEN 3 THEN 'ADJ' ELSE 'NUM' END AS upostag, CASE l_partkey % 5 WHEN 1 THEN 'V' WHEN 3 THEN 'A' WHEN 4 THEN 'N' ELSE 'S' END AS xpostag,
['Nom', 'Gen', 'Par', 'Add'][1 + l_suppkey % 4] AS cas, CASE WHEN l_linenumber % 2 = 0 THEN 'Sing' ELSE 'Plur' END AS num, CASE WHEN l_suppkey % 2 = 0 THEN 'Pres' ELSE 'Past' END AS tense, 1 + l_linenumber % 3 AS person,
CASE l_suppkey % 3 WHEN 0 THEN 'Pos' WHEN 1 THEN 'Cmp' ELSE 'Sup' END AS degree, CASE WHEN l_suppkey % 2 = 0 THEN 'Card' ELSE 'Ord' END AS numtype FROM lineitem)"""


def _ud(s, sf):
    k = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    li = t(s, sf, "lineitem")
    up = k("l_partkey", "NOUN", "VERB", "PROPN", "ADJ", "NUM")
    num = k("l_linenumber", "Sing", "Plur")
    feats = (
        F.when(up == "VERB", F.concat(F.lit("VerbForm=Fin|Mood=Ind|Voice=Act|Tense="), k("l_suppkey", "Pres", "Past"), F.lit("|Person="), (1 + F.col("l_linenumber") % 3).cast("string"), F.lit("|Number="), num))
        .when(up == "ADJ", F.concat(F.lit("Degree="), k("l_suppkey", "Pos", "Cmp", "Sup"), F.lit("|Case="), k("l_suppkey", "Nom", "Gen", "Par", "Add"), F.lit("|bad|Number="), num))
        .when(up == "NUM", F.concat(F.lit("NumType="), k("l_suppkey", "Card", "Ord"), F.lit("|Case="), k("l_suppkey", "Nom", "Gen", "Par", "Add"), F.lit("|Number=Dual|Number="), num))
        .otherwise(F.concat(F.lit("Case="), k("l_suppkey", "Nom", "Gen", "Par", "Add"), F.lit("|Number="), num))
    )
    return li.select(up.alias("upostag"), k("l_partkey", "S", "V", "S", "A", "N").alias("xpostag"), F.lit("x").alias("lemma"), X.feature_map(feats).alias("feats"))


@query(f"WITH {UD} SELECT upostag, num AS number, CASE WHEN upostag <> 'VERB' THEN cas END AS cas, count(*) AS n FROM u GROUP BY ALL")
def feature_map(s, sf):
    f = lambda k: F.try_element_at("feats", F.lit(k))
    return _ud(s, sf).groupBy("upostag", f("Number").alias("number"), f("Case").alias("cas")).agg(F.count("*").alias("n"))


@query(f"""WITH {UD}, v AS (SELECT *, CASE num WHEN 'Sing' THEN 'sg' ELSE 'pl' END AS nu FROM u), r AS (SELECT
CASE WHEN upostag = 'PROPN' THEN 'H' WHEN upostag = 'NUM' THEN (CASE numtype WHEN 'Card' THEN 'N' ELSE 'O' END) WHEN upostag = 'ADJ' AND degree = 'Cmp' THEN 'C' WHEN upostag = 'ADJ' AND degree = 'Sup' THEN 'U' ELSE xpostag END AS pos,
CASE WHEN upostag = 'VERB' THEN (CASE tense || person || num WHEN 'Pres1Sing' THEN 'n' WHEN 'Pres1Plur' THEN 'me' WHEN 'Pres2Sing' THEN 'd' WHEN 'Pres2Plur' THEN 'te' WHEN 'Pres3Sing' THEN 'b' WHEN 'Pres3Plur' THEN 'vad'
 WHEN 'Past1Sing' THEN 'sin' WHEN 'Past1Plur' THEN 'sime' WHEN 'Past2Sing' THEN 'sid' WHEN 'Past2Plur' THEN 'site' WHEN 'Past3Sing' THEN 's' ELSE 'sid' END)
 WHEN cas = 'Add' THEN 'adt' ELSE nu || ' ' || (CASE cas WHEN 'Nom' THEN 'n' WHEN 'Gen' THEN 'g' ELSE 'p' END) END AS form FROM v) SELECT form, pos, count(*) AS n FROM r GROUP BY ALL""")
def reduced_tags(s, sf):
    return V.reduced(_ud(s, sf)).groupBy("form", "pos").agg(F.count("*").alias("n"))


@query("SELECT event_type, cast(sum(len(list_filter([event_type, '<b>', '7', props, upper(event_type)], lambda x: NOT regexp_matches(x, '[<>/\\\\{}]') AND regexp_matches(x, '[A-Za-z]')))) AS BIGINT) AS n FROM events GROUP BY 1")
def candidate_filter(s, sf):
    c = F.array("event_type", F.lit("<b>"), F.lit("7"), "props", F.upper("event_type"))
    return t(s, sf, "events").groupBy("event_type").agg(F.sum(F.size(G.usable_candidates(c)).cast("long")).alias("n"))


@query("WITH v AS (SELECT user_id, event_type, sum(round(value)::BIGINT) AS w FROM events GROUP BY ALL) SELECT user_id, event_type AS pred_label, cast(w AS BIGINT) AS weight FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) = 1")
def vote_argmax(s, sf):
    return G.votes(t(s, sf, "events").withColumn("w0", F.round("value").cast("long")), "user_id", "event_type", "w0").select("user_id", "pred_label", "weight")


@query("SELECT event_id, round(round(value)::BIGINT / sum(round(value)::BIGINT) OVER (PARTITION BY user_id), 6) AS normalised_score FROM events")
def score_share(s, sf):
    return G.score_share(t(s, sf, "events").withColumn("v", F.round("value").cast("long")), "user_id", "v").select("event_id", "normalised_score")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 4 <> 0")
def resumable_filter(s, sf):
    d = t(s, sf, "documents").select("doc_id")
    return C.unprocessed(d, d.where("doc_id % 4 = 0"), d.where("doc_id % 10 = 3"), "doc_id")


@query("SELECT 'req-' || event_id AS custom_id, event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN cast(json_extract(props, '$.k') AS BIGINT) END, -1) AS k FROM events")
def batch_manifest_join(s, sf):
    e = t(s, sf, "events")
    manifest = G.batch_requests(e, "event_id", F.col("event_id")).withColumnRenamed("body", "event_id")
    responses = e.where("event_id % 3 <> 0").select(F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("custom_id"), F.col("props").alias("response"))
    return G.batch_results(manifest, responses, "k long").select("custom_id", "event_id", F.coalesce("parsed.k", F.lit(-1)).alias("k"))


@query("""WITH m AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY ALL), v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
z AS (SELECT vec_id, label, sum(v.x * m.x) AS z FROM v JOIN m USING (k) GROUP BY ALL) SELECT vec_id, cast(label AS VARCHAR) AS label, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, label) AS rank FROM z QUALIFY rank <= 3""")
def topn_labels(s, sf):
    return G.top_labels(G.centroid_stand_in(t(s, sf, "embeddings")), "vec_id", 3).select("vec_id", "label", F.col("rank").cast("long").alias("rank"))


@query()
def gated_prediction_stand_in(s, sf):
    base = G.top_labels(G.centroid_stand_in(t(s, sf, "embeddings")), "vec_id")
    expert = t(s, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.lit(1.0).alias("probability"))
    dense = (F.col("vec_id") % 10) / 10.0
    gate = t(s, sf, "embeddings").select("vec_id", dense.alias("density"), G.route(dense, F.col("vec_id") % 7 == 0, 0.8).alias("answers"))
    return G.gated_labels(base, expert, gate, ["vec_id"]).withColumns({c: F.round(c, 4) for c in ("probability", "baseline_probability", "expert_probability")})


@query(f"SELECT doc_id FROM documents WHERE len({SPLIT}) >= 4 AND len(list_filter({SPLIT}, lambda x: regexp_matches(x, '^\\p{{Ll}}'))) > 0 AND length(text) < 1500")
def eligible_sentences(s, sf):
    return t(s, sf, "documents").where(C.eligible(F.col("text"))).select("doc_id")


@query("WITH x AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT round(avg(n), 6) AS mean_length, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM x ORDER BY n, doc_id LIMIT 3)) AS shortest, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM x ORDER BY n DESC, doc_id LIMIT 3)) AS longest FROM x")
def length_stats(s, sf):
    r = C.length_stats(t(s, sf, "documents"), "text", "doc_id")
    return r.select("mean_length", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("shortest", "longest")])


@query(f"WITH {W} SELECT source, sentence_id, count(*) AS n FROM w WHERE sentence_id NOT IN (SELECT sentence_id FROM w WHERE lower(word) IN ('idiot', 'clown')) GROUP BY ALL")
def drop_flagged_sentences(s, sf):
    return C.drop_sentences_with(words(s, sf), F.lower("word").isin("idiot", "clown")).groupBy("source", "sentence_id").agg(F.count("*").alias("n"))


@query("""SELECT item_id, substr(text, 1, 3) || '<' || substr(text, 4, 5) || '>' || substr(text, 9) AS marked, substr(text, 1, 3) || 'XY' || substr(text, 9) AS substituted, replace(substr(text, 1, 28), chr(10), '\\n') AS snippet,
regexp_replace(substr(text, 1, 30), '[^0-9A-Za-z_.-]+', '_', 'g') AS safe, 'b|||' || item_id AS k, '5 / 8 (62.50%)' AS share FROM benchmark""")
def span_functions(s, sf):
    a, e = F.lit(3), F.lit(8)
    return t(s, sf, "benchmark").select(
        "item_id", X.mark_span(F.col("text"), a, e).alias("marked"), X.substitute_span(F.col("text"), a, e, F.lit("XY")).alias("substituted"), X.snippet(F.col("text"), a, e).alias("snippet"),
        X.safe_name(F.substring("text", 1, 30)).alias("safe"), X.sentence_key(F.lit("b"), F.col("item_id")).alias("k"), X.count_and_share(F.lit(5), F.lit(8)).alias("share"),
    )


@query()
def text_chunks(s, sf):
    return P.chunks(t(s, sf, "documents")).drop("piece")


@query("SELECT cast(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey < 10 THEN 'new' ELSE n_name END AS v FROM nation UNION ALL SELECT 100, 'new'")
def result_upsert(s, sf):
    old = t(s, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    new = old.where("k < 10").select("k").union(s.range(100, 101)).withColumn("v", F.lit("new"))
    return upsert(old, new, ["k"])


@query("SELECT 'a' AS orig_corpus, doc_id, lang, CAST(NULL AS VARCHAR) AS role, 42 AS seed FROM documents UNION ALL SELECT 'b', conv_id, NULL, role, 42 FROM conversations")
def corpus_concat(s, sf):
    return C.concat_corpora({"a": t(s, sf, "documents").select("doc_id", "lang"), "b": t(s, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "role")}, seed=42)
