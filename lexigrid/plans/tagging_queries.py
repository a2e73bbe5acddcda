"""Queries of the tagger, of subwords, of requests under a budget, chunks as a table function, differences, deliveries and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import tables as TF
from lexigrid.functions import text as X
from lexigrid.operators import budget as B
from lexigrid.operators import convert as V
from lexigrid.operators import corpus as C
from lexigrid.operators import differences as DI
from lexigrid.operators import metrics as M
from lexigrid.operators import sequences as Q
from lexigrid.operators import spans as P
from lexigrid.operators import subwords as SW
from lexigrid.operators import tagging as TG
from lexigrid.plans.corpus_queries import JUDGED, W, judged, query, t, words
from lexigrid.plans.layer_queries import CHUNKS
from lexigrid.session import scratch
from lexigrid.sources import incremental as I

# M2, M6: the score of the best path by dynamic programming over lists; four labels are written out
_STEP = ", ".join(f"greatest({', '.join(f'a[{i}] + m[{i}][{j}]' for i in range(1, 5))}) + e[{j}]" for j in range(1, 5))
_FIRST = ", ".join(f"s[{j}] + e[1][{j}]" for j in range(1, 5))


@query(f"""WITH {W}, w2 AS (SELECT *, lag(type) OVER (PARTITION BY source, sentence_id ORDER BY pos) AS prev FROM w), l AS (SELECT DISTINCT type AS label FROM w WHERE type IS NOT NULL),
em AS (SELECT word, type AS label, count(*) AS n FROM w WHERE type IS NOT NULL GROUP BY ALL), tot AS (SELECT label, sum(n) AS total FROM em GROUP BY 1), kinds AS (SELECT count(DISTINCT word) + 1 AS k FROM em),
vs AS (SELECT DISTINCT word FROM w), sc AS (SELECT word, list(cast(floor(ln((coalesce(n, 0) + 0.1::DOUBLE) / (cast(total AS DOUBLE) + 0.1::DOUBLE * k)) * 1000000) AS BIGINT) ORDER BY label) AS e FROM vs CROSS JOIN tot CROSS JOIN kinds LEFT JOIN em USING (word, label) GROUP BY word),
mv AS (SELECT prev AS a, type AS b, count(*) AS n FROM w2 WHERE type IS NOT NULL GROUP BY ALL), fr AS (SELECT a, sum(n) AS total FROM mv GROUP BY a), nl AS (SELECT count(*) AS k FROM l),
st AS (SELECT list(cast(floor(ln((coalesce(n, 0) + 0.1::DOUBLE) / (cast(total AS DOUBLE) + 0.1::DOUBLE * k)) * 1000000) AS BIGINT) ORDER BY label) AS s FROM l CROSS JOIN nl CROSS JOIN (SELECT total FROM fr WHERE a IS NULL) LEFT JOIN (SELECT b, n FROM mv WHERE a IS NULL) x ON label = b),
mr AS (SELECT p.label AS a, list(cast(floor(ln((coalesce(mv.n, 0) + 0.1::DOUBLE) / (cast(coalesce(total, 0) AS DOUBLE) + 0.1::DOUBLE * k)) * 1000000) AS BIGINT) ORDER BY q.label) AS r FROM l p CROSS JOIN l q CROSS JOIN nl LEFT JOIN mv ON mv.a = p.label AND mv.b = q.label LEFT JOIN fr ON fr.a = p.label GROUP BY p.label),
mm AS (SELECT list(r ORDER BY a) AS m FROM mr), sn AS (SELECT source, sentence_id, list(e ORDER BY pos) AS e FROM w JOIN sc USING (word) GROUP BY ALL)
SELECT sentence_id, len(e) AS words, list_max(list_reduce(e[2:], lambda a, e: [{_STEP}], [{_FIRST}])) AS best_score FROM sn CROSS JOIN st CROSS JOIN mm""")
def best_label_paths(s, sf):
    """Each word of a document is tagged with a language, from words and successions counted over all documents."""
    sentences = C.whole_sentences(t(s, sf, "documents"))
    tagged = TG.decode_sentences(sentences, TG.fit_sentences(sentences, C.words_of("text"), "types"), ["source", "sentence_id"], C.words_of("text"))
    return tagged.where(F.col("best_score").isNotNull()).select("sentence_id", F.size("pred_labels").cast("long").alias("words"), "best_score")


PIECES = f"""WITH RECURSIVE {W}, c AS (SELECT word AS w, count(*) AS n FROM w GROUP BY 1), p AS (
SELECT n, unnest(list_distinct([substr('▁' || w, 1, least(k, 12)) for k in range(1, length(w) + 2)])) AS piece FROM c UNION ALL
SELECT n, unnest(flatten([[substr(w, a, k) for k in range(1, least(12, length(w) - a + 1) + 1)] for a in range(1, length(w) + 1)])) AS piece FROM c),
g AS (SELECT piece, cast(sum(n) AS BIGINT) AS n, length(regexp_replace(piece, '^▁', '')) <= 1 AS single FROM p GROUP BY piece),
v AS (SELECT piece, n FROM g WHERE single OR n >= 2 ORDER BY single DESC, n DESC, piece LIMIT 20000)"""


@query(f"{PIECES} SELECT piece, n FROM v")
def counted_pieces(s, sf):
    return SW.count_pieces(words(s, sf), most=20_000)


@query(f"""{PIECES}, r AS (SELECT w, '▁' || w AS txt, cast(1 AS BIGINT) AS place, cast(0 AS BIGINT) AS n FROM c UNION ALL
SELECT w, txt, place + max(k), any_value(r.n) + 1 FROM r CROSS JOIN range(1, 13) x(k) JOIN v ON v.piece = substr(txt, place, k) AND place + k - 1 <= length(txt) GROUP BY w, txt, place),
d AS (SELECT w, n FROM r WHERE place > length(txt))
SELECT sentence_id AS doc_id, cast(sum(coalesce(d.n, 1)) AS BIGINT) AS pieces, count(*) FILTER (d.n IS NULL) AS unknown FROM w LEFT JOIN d ON w.word = d.w GROUP BY 1""")
def trie_subwords(s, sf):
    """Pieces of every document by longest match, and how many of them stand for a word that the pieces can't make up."""
    docs = t(s, sf, "documents")
    load = SW.trie_tokenizer(SW.count_pieces(words(s, sf), most=20_000))
    spans = Q.subtoken_spans(docs, load)
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("piece") == SW.UNKNOWN).alias("unknown"))


@query("""WITH r AS (SELECT conv_id, turn, length(coalesce(text, '')) // 4 + 1 AS tokens FROM conversations), x AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT cast(floor(before / 2000) AS BIGINT) AS minute, count(*) AS requests, cast(sum(tokens) AS BIGINT) AS tokens, cast(sum(tokens * 3) AS BIGINT) AS cost FROM x WHERE before * 3 < 150000 GROUP BY 1""")
def request_minutes(s, sf):
    r = t(s, sf, "conversations").select("conv_id", "turn", (F.floor(F.length(F.coalesce("text", F.lit(""))) / 4) + 1).alias("tokens"))
    cost = F.col("tokens") * 3
    return B.slots(B.schedule(r, ["conv_id", "turn"], F.col("tokens"), cost, 2_000, 150_000), F.col("tokens"), cost)


@query(CHUNKS)
def text_chunks_in_sql(s, sf):
    TF.register(s)
    return s.sql("SELECT doc_id, c.chunk, c.start, c.`end` FROM {docs} d, LATERAL text_chunks(d.text, 1000) c", docs=t(s, sf, "documents"))


@query("""WITH x AS (SELECT doc_id, string_split(lower(coalesce(text, '')), ' ') AS a, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: length(w) <> 1) AS b FROM documents),
y AS (SELECT *, [k - 1 FOR k IN range(1, greatest(len(a), len(b)) + 1) IF a[k] IS DISTINCT FROM b[k]] AS u FROM x)
SELECT doc_id, cast(len(a) AS INT) AS n_a, cast(len(b) AS INT) AS n_b, cast(coalesce(u[1], -1) AS INT) AS first, cast(len(u) AS INT) AS mismatches, len(b) AS same FROM y""")
def encoder_differences(s, sf):
    """Words as one encoder gives them and as one gives them that passes over single letters."""
    ws = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    docs = t(s, sf, "documents").select("doc_id", ws.alias("a"), F.filter(ws, lambda w: F.length(w) != 1).alias("b"))
    return DI.sequence_differences(docs, ["doc_id"], "a", "b").drop("places").withColumn("first", F.coalesce("first", F.lit(-1)))


@query("SELECT lang, count(*) AS n, count(*) FILTER (text IS NULL OR length(text) < 50) AS errors FROM documents GROUP BY lang")
def documents_taken_once(s, sf):
    """Two deliveries of files, each taken once though the second run sees both; short documents are counted as errors."""
    base, docs = scratch(s, "stream"), t(s, sf, "documents").select("doc_id", "lang", "text")
    error = F.when(F.coalesce(F.length("text"), F.lit(0)) < 50, F.lit("too short"))
    for k in range(2):
        docs.where(F.col("doc_id") % 2 == k).write.mode("append").json(f"{base}/in")
        for _ in range(2):
            I.process_new_files(s, f"{base}/in", "doc_id long, lang string, text string", lambda d: d, error, f"{base}/out", f"{base}/state")
    good, bad = I.processed(s, f"{base}/out")
    both = good.select("lang", F.lit(0).alias("e")).unionByName(bad.select("lang", F.lit(1).alias("e")))
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("errors"))


@query("""WITH x AS (SELECT user_id, event_id, event_id // 8 AS s, list_sort(list_distinct([CASE event_id % 5 WHEN 0 THEN 'B-' WHEN 4 THEN 'O' ELSE 'I-' END || CASE WHEN event_id % 5 = 4 THEN '' ELSE event_type END, CASE WHEN event_id % 3 = 0 THEN 'I-view' ELSE 'O' END])) AS tg FROM events),
y AS (SELECT *, [regexp_replace(v, '^[BI]-', '') FOR v IN tg] AS k FROM x), p AS (SELECT *, lag(k[-1]) OVER u AS pk, lag(s) OVER u AS ps FROM y WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
z AS (SELECT *, CASE WHEN starts_with(tg[1], 'I-') AND pk = k[1] AND ps = s THEN 0 ELSE 1 END AS new FROM p), q AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM z)
SELECT user_id, min(event_id) AS start, max(event_id) AS "end", array_to_string(list_sort(list_distinct(list_filter(flatten(list(k)), lambda v: v <> 'O'))), '|') AS type FROM q WHERE tg[1] <> 'O' GROUP BY user_id, island""")
def merged_tags_by_sentence(s, sf):
    k, kind = F.col("event_id") % 5, F.col("event_type")
    first = F.when(k == 0, F.concat(F.lit("B-"), kind)).when(k == 4, "O").otherwise(F.concat(F.lit("I-"), kind))
    e = t(s, sf, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 8).alias("s"), F.array(first, F.when(F.col("event_id") % 3 == 0, "I-view").otherwise("O")).alias("tag"), F.lit("w").alias("word"))
    return P.merge_tags(e, ["user_id"], "event_id", sentence="s").drop("phrase")


def _hits(true, pred):
    return int((true == pred).sum()), len(true)


def _short(true, pred):
    return int(((pred == "short") & (true == "1")).sum()), int((true == "1").sum())


@query(f"WITH {JUDGED} SELECT lang AS grp, round(count(*) FILTER (t = p) / count(*), 6) AS hit_rate, round(count(*) FILTER (p = 'short' AND t = '1') / nullif(count(*) FILTER (t = '1'), 0), 6) AS short_ones FROM j WHERE lang IS NOT NULL GROUP BY lang")
def metrics_of_ones_own(s, sf):
    share = F.round(F.try_divide(F.col("hits").cast("double"), F.col("n")), 6)
    own = [M.Metric("hit_rate", {"hits": "long", "n": "long"}, _hits, share), M.Metric("short_ones", {"hits": "long", "n": "long"}, _short, share)]
    return M.evaluate_with(judged(s, sf), own, group="lang")


@query("""WITH k AS (SELECT l_partkey % 8 AS kind, l_suppkey % 3 AS a, l_linenumber % 2 AS b, 1 + l_linenumber % 3 AS p FROM lineitem)
SELECT CASE kind WHEN 0 THEN 'da' WHEN 1 THEN ['ma', 'mas', 'mast'][a + 1] WHEN 2 THEN ['nud', 'tud'][b + 1] WHEN 3 THEN ['neg o', 'neg nud'][b + 1] WHEN 4 THEN ['o', 'neg ge'][b + 1]
WHEN 5 THEN (CASE WHEN b = 0 THEN ['', 'o', 'gu'][p] ELSE ['gem', 'ge', 'gu'][p] END) WHEN 6 THEN ['vat', 'tavat'][b + 1] ELSE (CASE WHEN b = 0 THEN ['ksin', 'ksid', 'ks'][p] ELSE ['ksime', 'ksite', 'ksid'][p] END) END AS form, 'V' AS pos, count(*) AS n FROM k GROUP BY ALL""")
def reduced_verbs(s, sf):
    """Infinite, negative, imperative, quotative and conditional forms."""
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) + 1).cast("int"))
    li = t(s, sf, "lineitem").select((F.col("l_partkey") % 8).alias("kind"), (F.col("l_suppkey") % 3).alias("a"), (F.col("l_linenumber") % 2).alias("b"), (1 + F.col("l_linenumber") % 3).cast("string").alias("p"))
    num = pick("b", "Sing", "Plur")
    feats = F.element_at(F.array(
        F.lit("VerbForm=Inf"), F.concat(F.lit("VerbForm=Sup|Voice=Act|Case="), pick("a", "Ill", "Ine", "Ela")), F.concat(F.lit("VerbForm=Part|Tense=Past|Voice="), pick("b", "Act", "Pass")),
        F.concat(F.lit("Connegative=Yes|Voice=Act|Mood=Ind|Tense="), pick("b", "Pres", "Past")), F.concat(F.lit("Polarity=Neg|Voice=Act|Mood=Imp|Tense=Pres|Person=2|Number="), num),
        F.concat(F.lit("Mood=Imp|Tense=Pres|Voice=Act|Person="), "p", F.lit("|Number="), num), F.concat(F.lit("Mood=Qot|Tense=Pres|Voice="), pick("b", "Act", "Pass")),
        F.concat(F.lit("Mood=Cnd|Tense=Pres|Voice=Act|Person="), "p", F.lit("|Number="), num),
    ), (F.col("kind") + 1).cast("int"))
    rows = li.select(F.lit("VERB").alias("upostag"), F.lit("V").alias("xpostag"), F.lit("x").alias("lemma"), X.feature_map(feats).alias("feats"))
    return V.reduced(rows).groupBy("form", "pos").agg(F.count("*").alias("n"))
