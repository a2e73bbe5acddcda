"""Row selection, counting and ordering by keys. All of it is semi, anti and aggregate plans without a driver's help."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.labels import PLACEHOLDERS, is_placeholder
from lexigrid.operators.corpus import dense_ids

#: Fixed value: the label id of subtokens that no loss and no score counts.
IGNORED = -100


def without_placeholders(df: DataFrame, label: str = "true_label", placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """rows whose label is a real one."""
    return df.where(~is_placeholder(F.col(label), placeholders))


def split_of(name: Column, splits: tuple[str, ...] = ("train", "dev", "test")) -> Column:
    """the split that a source's name speaks of, whatever the case; of several the first in ``splits``; null if none."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(s), s) for s in splits])


def members(df: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys stand in ``ids``; repeated ids count once and null keys never match."""
    return df.join(ids.select(*keys), list(keys), "left_semi")


def with_sentence(keys: DataFrame, sentences: DataFrame, on: tuple[str, ...] = ("source", "sentence_id")) -> DataFrame:
    """The sentence rows of the keys, an inner join on both; repeated keys repeat their sentence."""
    return keys.join(sentences, list(on))


def not_picked(sents: DataFrame, picked: DataFrame, text: str = "text") -> DataFrame:
    """F8: sentences whose text no earlier pick has. Null texts were never picked."""
    return sents.join(picked.select(text).distinct(), text, "left_anti")


def fill_missing(rows: DataFrame, word: str = "word", fill: tuple[str, ...] = ("form", "pos"), value: str = "") -> DataFrame:
    """rows without a word go; other null parts become ``value``."""
    return rows.dropna(subset=[word]).fillna(value, list(fill))


def counted_tokens(df: DataFrame, label_id: str = "label_id") -> DataFrame:
    """rows that losses and scores count."""
    return df.where(F.col(label_id) != IGNORED)


def group_count(df: DataFrame, *columns: str) -> DataFrame:
    """A10: one row, the number of groups; a group with null parts is a group."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("groups"))


def mispredictions(df: DataFrame, *groups: str, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Rows of each group whose prediction is not the true label, and all its rows."""
    return df.groupBy(*groups).agg(F.count_if(~F.col(true).eqNullSafe(F.col(pred))).alias("wrong"), F.count(F.lit(1)).alias("n"))


def decisions_in_text(df: DataFrame, text: str, decisions: tuple[str, ...]) -> DataFrame:
    """How many rows speak of each decision as a whole word, whatever the case; 0 for those that none does."""
    hits = F.filter(F.array(*map(F.lit, decisions)), lambda d: F.regexp_like(F.lower(F.col(text)), F.concat(F.lit(r"\b"), F.lower(d), F.lit(r"\b"))))
    found = df.select(F.explode(hits).alias("decision")).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(d,) for d in decisions], "decision string")
    return names.join(found, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))


def diff_categories(diff: DataFrame, category: str = "category") -> DataFrame:
    """Diffs of each category, and their share of all in percent with two places; null counts as ``none``."""
    n = diff.groupBy(F.coalesce(category, F.lit("none")).alias(category)).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select(category, "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percent"))


def continued_ids(df: DataFrame, file_order: str, local_id: str, ids: str = "continued_id") -> DataFrame:
    """Sentence ids that go on from file to file, from 0."""
    return dense_ids(df, [file_order, local_id], ids)


def source_order(rows: DataFrame, source: str = "source", order: str = "ord") -> DataFrame:
    """Sources with the place of their first row; sorting by it keeps the order in which they came."""
    return rows.groupBy(source).agg(F.min(order).alias("first_ord"))


def sorted_rows(df: DataFrame, value: str, tie: str, descending: bool = True, index: str = "index") -> DataFrame:
    """Rows with their place from 0 when sorted by value, then tie (unique); nulls last. No task sees all rows."""
    key = df.withColumns({"__null": F.col(value).isNull(), "__key": -F.col(value) if descending else F.col(value)})
    return dense_ids(key, ["__null", "__key", tie], index).drop("__null", "__key")


def sorted_distribution(names: DataFrame, counts: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """Every name with its count, 0 where there is none, and its place by count, then name."""
    all_of = names.select(label).distinct().join(counts.select(label, n), label, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return sorted_rows(all_of, n, label)


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """U5s."""
    return df.select(*columns).dropDuplicates()
