"""Two scorers behind a word-list gate, votes over candidates, and the scorer boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.labels import is_placeholder, normalise_placeholder
from lexigrid.operators.corpus import in_list
from lexigrid.operators.metrics import report


def density(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Hits / words of each sentence."""
    return in_list(rows, words).groupBy("source", "sentence_id").agg(F.count("*").alias("words"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("density"))


def check_threshold(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")


def route(dense: Column, hit: Column, threshold: float = 1.0) -> Column:
    """M3: expert for a dense sentence, else for listed words only."""
    check_threshold(threshold)
    return F.when((dense >= threshold) | hit, "expert").otherwise("baseline")


def gate_words(rows: DataFrame, words: DataFrame, threshold: float = 1.0, label_col: str | None = None) -> DataFrame:
    """Word rows with their sentence's density and the scorer that answers for them; placeholder labels go to neither."""
    flagged = in_list(rows, words)
    dense = flagged.groupBy("source", "sentence_id").agg(F.avg(F.col("hit").cast("double")).alias("density"))
    out = flagged.join(dense, ["source", "sentence_id"])
    picked = route(F.col("density"), F.col("hit"), threshold)
    return out.withColumn("answers", F.when(is_placeholder(F.col(label_col)), "placeholder").otherwise(picked) if label_col else picked)


def gate_stats(rows: DataFrame, words: DataFrame, threshold: float = 1.0, label_col: str | None = None) -> DataFrame:
    """One row: tokens of each scorer and their shares; 0 if there are none. Per-sentence counts are summed, so the
    density needs no join back to the words."""
    flagged = in_list(rows, words)
    if label_col:
        flagged = flagged.withColumn("ph", is_placeholder(F.col(label_col)))
    else:
        flagged = flagged.withColumn("ph", F.lit(False))
    one = flagged.groupBy("source", "sentence_id").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("d"), F.count_if("ph").alias("ph"), F.count_if(F.col("hit") & ~F.col("ph")).alias("h"))
    expert = F.when(F.col("d") >= threshold, F.col("n") - F.col("ph")).otherwise(F.col("h"))
    s = one.agg(F.count("*").alias("sentences"), F.sum("n").alias("tokens"), F.sum(expert).alias("expert"), F.sum("ph").alias("placeholder"), F.avg("d").alias("mean_density"))
    z = lambda c: F.coalesce(c, F.lit(0))
    s = s.select("sentences", z("tokens").alias("tokens"), z("expert").alias("expert"), z("placeholder").alias("placeholder"), (z("tokens") - z("expert") - z("placeholder")).alias("baseline"), F.round(F.coalesce("mean_density", F.lit(0.0)), 6).alias("mean_density"))
    return s.withColumn("expert_share", F.round(F.coalesce(F.try_divide(F.col("expert"), F.col("tokens")), F.lit(0.0)), 6))


def gated_labels(base: DataFrame, expert: DataFrame, gate: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Label, probability and answering scorer of each word from two prediction tables (label, probability).

    The gate's columns ``keep`` stay, so that they need no join of the words with themselves.
    """
    b = base.select(*keys, F.col("label").alias("b_label"), F.col("probability").alias("baseline_probability"))
    e = expert.select(*keys, F.col("label").alias("e_label"), F.col("probability").alias("expert_probability"))
    out = gate.join(b, keys).join(e, keys)
    who = F.col("answers")
    label = F.when(who == "placeholder", normalise_placeholder(F.lit(None).cast("string"))).when(who == "expert", F.col("e_label")).otherwise(F.col("b_label"))
    p = F.when(who == "placeholder", F.lit(0.0)).when(who == "expert", F.col("expert_probability")).otherwise(F.col("baseline_probability"))
    return out.select(*keys, "density", who.alias("source_model"), label.alias("pred_label"), p.alias("probability"), "baseline_probability", "expert_probability", *keep)


def score_with(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """M1, M2: a scorer that is loaded once a task and fed Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for f in frames:
            yield scorer(f)

    return df.mapInPandas(run, schema)


def centroid_stand_in(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """M2, T4: a stand-in scorer, not a model of the reference: softmax of dot products with the label means; (id, label, probability).

    The means are one row, as many arrays as there are labels, which the plan joins to every vector.
    """
    means = vectors.select(F.col(label).cast("string").alias("label"), F.posexplode(vector).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    one = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("mean"))
    table = one.agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("means"))  # one row
    dot = lambda m: F.aggregate(F.zip_with(F.col(vector), m["mean"], lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    z = vectors.select(id_col, vector).crossJoin(F.broadcast(table)).select(id_col, F.transform("means", lambda m: F.struct(m["label"].alias("label"), dot(m).alias("z"))).alias("zs"))
    z = z.withColumn("most", F.array_max(F.transform("zs", lambda x: x["z"])))
    e = z.select(id_col, F.transform("zs", lambda x: F.struct(x["label"].alias("label"), F.exp(x["z"] - F.col("most")).alias("e"))).alias("es"))
    e = e.withColumn("sum", F.aggregate("es", F.lit(0.0), lambda s, x: s + x["e"]))
    return e.select(id_col, "sum", F.explode("es").alias("x")).select(id_col, "x.label", (F.col("x.e") / F.col("sum")).alias("probability"))


def within_sequence(pred: DataFrame, rows: DataFrame, keys: list[str], placeholders: tuple[str, ...] = ("-", "NONE")) -> DataFrame:
    """M2: a prediction for every row; words that stand beyond the scored sequence have the placeholder and probability 0."""
    out = rows.join(pred.select(*keys, "label", "probability"), keys, "left")
    return out.withColumns({"pred_label": F.coalesce("label", F.lit(min(placeholders))), "probability": F.coalesce("probability", F.lit(0.0))}).drop("label")


def evaluate(rows: DataFrame, pred: DataFrame, keys: list[str], true: str = "true_label", group: str | None = None) -> DataFrame:
    """M4: predictions, then the metrics, over rows with a real true label."""
    scored = within_sequence(pred, rows.where(~is_placeholder(F.col(true))), keys)
    return report(scored, true, "pred_label", group)


def gated_counts(rows: DataFrame, base: str, expert: str, words: DataFrame, threshold: float, true: str = "true_label", group: str | None = None) -> DataFrame:
    """M5: (grp, t, p, ph, answered, n): numbers of words by true and gated label, ``answered`` of them by the expert; ph are placeholders.

    ``base`` and ``expert`` are columns of the rows. Words are counted within their sentence by their labels, if the expert
    answers for all of it or for listed words only; its density chooses between the two. So no word is joined or
    moved, if the list is small enough to be broadcast. Sentences without source or id are left out, as by a join.
    """
    check_threshold(threshold)
    named = rows.where(F.col("source").isNotNull() & F.col("sentence_id").isNotNull())
    sparse = F.when(F.col("hit"), F.col(expert)).otherwise(F.col(base))
    labels = [F.col(group).alias("grp") if group else F.lit(None).cast("string").alias("grp"), F.col(true).alias("t"), F.col(expert).alias("dense"), sparse.alias("sparse"), is_placeholder(F.col(true)).alias("ph")]
    flagged = in_list(named, words, counted=True).select("source", "sentence_id", *labels, "hit")
    one = flagged.groupBy("source", "sentence_id", "grp", "t", "dense", "sparse", "ph").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    sentence = Window.partitionBy("source", "sentence_id")
    whole = F.sum("hits").over(sentence) / F.sum("n").over(sentence) >= threshold
    judged = one.withColumn("whole", whole)
    return judged.select("grp", "t", F.when(F.col("whole"), F.col("dense")).otherwise(F.col("sparse")).alias("p"), "ph", F.when(F.col("whole"), F.col("n")).otherwise(F.col("hits")).alias("answered"), "n")


def gated_evaluate(rows: DataFrame, base: DataFrame | str, expert: DataFrame | str, words: DataFrame, threshold: float, keys: list[str], true: str = "true_label", group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M5: (metrics, shares of the scorers) of gated predictions over word rows with a real true label.

    Predictions are tables (label, probability) with the keys, which are joined, or columns of the rows, which need no join.
    """
    if isinstance(base, str) != isinstance(expert, str):
        raise ValueError("predictions are two tables or two columns")
    if isinstance(base, str):
        one = gated_counts(rows, base, expert, words, threshold, true, group)
        who = {"placeholder": F.when(F.col("ph"), F.col("n")), "expert": F.when(~F.col("ph"), F.col("answered")), "baseline": F.when(~F.col("ph"), F.col("n") - F.col("answered"))}
        sums = one.agg(*[F.sum(n).alias(k) for k, n in who.items()])
        shares = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("answers"), F.col(k).alias("n")) for k in who])).alias("x")).select("x.*").where("n > 0")
        return report(one.where(~F.col("ph")), "t", "p", "grp" if group else None, "n"), shares
    gate = gate_words(rows, words, threshold, true)
    real = gate.where(F.col("answers") != "placeholder")
    keep = dict.fromkeys(c for c in (true, group) if c and c not in keys)
    scored = gated_labels(base, expert, real, keys, tuple(keep))
    shares = gate.groupBy("answers").agg(F.count(F.lit(1)).alias("n"))
    return report(scored, true, "pred_label", group), shares


def top_labels(scores: DataFrame, id_col: str, n: int = 1) -> DataFrame:
    """T4: the n most probable labels of each id; ties by label."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("probability"), "label"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def votes(df: DataFrame, id_col: str, label: str, weight: str) -> DataFrame:
    """Summed weights as a map, and the label of the largest; ties go to the first label by name."""
    one = df.groupBy(id_col, label).agg(F.sum(weight).alias("w"))
    best = F.min_by(F.col(label), F.struct((-F.col("w")).alias("w"), F.col(label).alias("l")))
    return one.groupBy(id_col).agg(best.alias("pred_label"), F.max("w").alias("weight"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "w")))).alias("distribution"))


def most_common(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """The most common label of each id; ties by label."""
    return votes(df.withColumn("__one", F.lit(1)), id_col, label, "__one").select(id_col, "pred_label")


def score_share(df: DataFrame, id_col: str, score: str) -> DataFrame:
    """M10."""
    return df.withColumn("normalised_score", F.round(F.try_divide(F.col(score), F.sum(score).over(Window.partitionBy(id_col))), 6))


def usable_candidates(candidates: Column) -> Column:
    """strings with a letter and without markup or marker words. Markers are compared in lower case on both sides."""
    return F.filter(candidates, lambda c: c.isNotNull() & ~c.rlike(r"[<>/\\{}]") & c.rlike(r"\p{L}") & ~F.lower(c).rlike(r"notused|madeupword|unused|unk|mask|pad"))


def batch_requests(df: DataFrame, id_col: str, body: Column) -> DataFrame:
    """Request lines with their custom ids."""
    return df.select(F.concat(F.lit("req-"), F.col(id_col).cast("string")).alias("custom_id"), body.alias("body"))


def batch_results(manifest: DataFrame, responses: DataFrame, schema: str) -> DataFrame:
    """Every manifest row with its parsed response, null where there is none."""
    r = responses.select("custom_id", F.from_json("response", schema).alias("parsed"))
    return manifest.join(r, "custom_id", "left")


#: The states in which a batch job is over.
TERMINAL = ("completed", "failed", "expired", "cancelled")


def finished(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Jobs that are over, whatever came of them."""
    return jobs.where(F.lower(status).isin(*TERMINAL))
