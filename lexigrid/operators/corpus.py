"""Word rows, sentences, sizes, ids and set operations. Every table has an order column; every "first" is by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.session import cut


def word_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", type_col: str = "lang") -> DataFrame:
    """One row a word: sentence_id, source, type, pos (from 0), word. Empty words are dropped (F1)."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\s+", " ")), " ")
    rows = docs.select(F.col(id_col).alias("sentence_id"), F.col(source_col).alias("source"), F.col(type_col).alias("type"), F.posexplode(words).alias("pos", "word"))
    return rows.where("word <> ''")


#: Names of sentences, or words of a list, that are broadcast at most.
BROADCAST_NAMES = 200_000


def words_of(text: Column | str) -> Column:
    """The words of ``word_rows`` as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def whole_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", type_col: str = "lang") -> DataFrame:
    """The rows of ``word_rows`` as one row a sentence: sentence_id, source, text (``words_of`` it are the words), types of the words. Sentences without words are dropped.

    A text that alone has its source and id stays where it stands. Texts that share both, nulls being equal, are one
    sentence: their words are gathered, those of one place in the order of the word.
    """
    own = docs.select(F.col(id_col).alias("sentence_id"), F.col(source_col).alias("source"), F.col(type_col).alias("type"), F.col(text_col).alias("text"))
    name = own.groupBy("sentence_id", "source").count().where("count > 1").select(F.col("sentence_id").alias("__id"), F.col("source").alias("__source"))
    name = cut(name)
    repeated = name.count()
    alone = own
    if repeated:
        name = F.broadcast(name) if repeated <= BROADCAST_NAMES else name
        same = F.col("sentence_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
        alone = own.join(name, same, "left_anti")
    out = alone.where(F.col("text").rlike(r"\S")).select("sentence_id", "source", "text", F.array_repeat("type", F.size(words_of("text"))).alias("types"))
    if repeated:
        rows = word_rows(own.join(name, same, "left_semi"), "sentence_id", "text", "source", "type")
        x = rows.groupBy("sentence_id", "source").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "type"))).alias("x"))
        out = out.unionByName(x.select("sentence_id", "source", F.array_join("x.word", " ").alias("text"), F.col("x.type").alias("types")))
    return out


def sentence_sizes(rows: DataFrame) -> DataFrame:
    """A1: words in each (source, sentence_id)."""
    return rows.groupBy("source", "sentence_id").agg(F.count("*").alias("size"))


def source_sizes(rows: DataFrame) -> DataFrame:
    """A2, A3: words, sentences and the first sentence's type of each source."""
    one = rows.groupBy("source", "sentence_id").agg(F.count("*").alias("size"), F.min("type").alias("type"))
    return one.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("sentences"), F.min_by("type", "sentence_id").alias("first_type"))


def sentences(rows: DataFrame, word_col: str = "word", label_col: str | None = None) -> DataFrame:
    """Words (and labels) of each sentence in order, and its text. A sentence is the unit that is gathered."""
    parts = F.sort_array(F.collect_list(F.struct("pos", F.col(word_col).alias("w"), (F.col(label_col) if label_col else F.lit(None).cast("string")).alias("l"))))
    out = rows.groupBy("source", "sentence_id").agg(parts.alias("p"))
    out = out.select("source", "sentence_id", F.col("p.w").alias("words"), F.col("p.l").alias("labels"))
    return out.withColumn("sentence", F.array_join("words", " ")) if label_col else out.drop("labels").withColumn("sentence", F.array_join("words", " "))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of each value, and their share in percent."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select(*columns, "n", F.round(F.col("n") * 100.0 / F.col("total"), 3).alias("percent"))


def share_in_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Counts of values in a group, with their share of the group."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(group)), 3))


def empty_per_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """A6."""
    return df.groupBy(group).agg(F.count_if((F.col(column) == "") | F.col(column).isNull()).alias("empty"), F.count("*").alias("n"))


def dense_ids(df: DataFrame, keys: list[str], ids: str, order: Column | None = None) -> DataFrame:
    """Ids from 0 for the distinct keys, in key order or in the order of the least ``order``.

    Ranges of the sorted keys are numbered apart and then shifted by the sizes of the ranges before, so
    that no task sees all keys; the ids are joined back.
    """
    seen = df.groupBy(*keys).agg((F.min(order) if order is not None else F.lit(0)).alias("__o"))
    parts = seen.repartitionByRange("__o", *keys).sortWithinPartitions("__o", *keys) if order is not None else seen.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = cut(parts.select(*keys, "__o", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__least"))
    shifts = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    numbered = parts.join(F.broadcast(shifts), "__p").select(*keys, (F.col("__m") - F.col("__least") + F.col("__shift")).alias(ids))
    numbered = numbered.toDF(*[f"__k_{k}" for k in keys], ids)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(numbered, cond).drop(*[f"__k_{k}" for k in keys])


def flag_duplicates(sents: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """Duplicated is true for all but the first row of a text; nothing is dropped."""
    first = sents.groupBy(F.col(text).alias("__t")).agg(F.min(order).alias("__first"))
    joined = sents.join(first, F.col(text).eqNullSafe(F.col("__t")))
    return joined.withColumn("duplicated", F.col(order) > F.col("__first")).drop("__t", "__first")


def concat_corpora(parts: dict[str, DataFrame], **provenance: str) -> DataFrame:
    """U1s: rows of all corpora by column name, with the corpus and what else is given."""
    tagged = [df.withColumn("orig_corpus", F.lit(name)) for name, df in parts.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return out.withColumns({k: F.lit(v) for k, v in provenance.items()})


def drop_sentences_with(rows: DataFrame, bad: Column) -> DataFrame:
    """whole sentences go if any of their rows is bad."""
    return rows.join(rows.where(bad).select("source", "sentence_id").distinct(), ["source", "sentence_id"], "left_anti")


def unprocessed(items: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """items that failed, or that are not done."""
    d, f = done.select(key, F.lit(True).alias("__d")).distinct(), failed.select(key, F.lit(True).alias("__f")).distinct()
    return items.join(d, key, "left").join(f, key, "left").where("__f or __d is null").drop("__d", "__f")


def eligible(text: Column, least_words: int = 4, most_chars: int = 1500) -> Column:
    """enough words, one that starts in lower case, and not too long."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return (F.size(words) >= least_words) & F.exists(words, lambda w: F.substring(w, 1, 1).rlike(r"^\p{Ll}")) & (F.length(text) < most_chars)


def in_list(rows: DataFrame, words: DataFrame, word_col: str = "word", counted: bool = False) -> DataFrame:
    """Hit is true if the lower-cased word is in the list (column ``word``).

    If ``counted``, the list is made and counted first, and broadcast if it has at most BROADCAST_NAMES words, so that no row moves.
    """
    known = words.select(F.lower("word").alias("__w")).distinct().withColumn("__hit", F.lit(True))
    if counted:
        known = cut(known)
        known = F.broadcast(known) if known.count() <= BROADCAST_NAMES else known
    return rows.join(known, F.lower(F.col(word_col)) == F.col("__w"), "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__w", "__hit")


def lexicon_lookup(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Forms that a lexicon has for their inflection type; several entries count once."""
    return forms.join(lexicon.select("inflect_type", "form", "pos").distinct(), ["inflect_type", "form", "pos"], "left_semi")


def zip_columns(a: DataFrame, b: DataFrame, order: str = "ord") -> DataFrame:
    """Rows with the same ordinal, side by side; a row without its pair is an error."""
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), order, "full")
    return both.where(F.when(F.col("__a") & F.col("__b"), True).otherwise(F.raise_error(F.lit("rows without a pair")).cast("boolean"))).drop("__a", "__b")


def split_counts(df: DataFrame, group: list[str], split: str) -> DataFrame:
    """Rows of each group over all, train and test, and the ratios of the two to all."""
    n = df.groupBy(*group).agg(F.count("*").alias("overall"), F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "test").alias("test"))
    return n.withColumns({"train_ratio": F.round(F.try_divide(F.col("train"), F.col("overall")), 6), "test_ratio": F.round(F.try_divide(F.col("test"), F.col("overall")), 6)})


def length_stats(df: DataFrame, text: str, key: str, k: int = 3) -> DataFrame:
    """Mean length, and the keys of the k shortest and k longest texts."""
    size = df.select(F.col(key).alias("k"), F.length(text).alias("n")).where("n is not null")
    top = lambda *o: size.orderBy(*o).limit(k).agg(F.sort_array(F.collect_list("k")).alias("ks"))  # noqa: E731  k rows
    mean = size.agg(F.round(F.avg("n"), 6).alias("mean_length"))
    return mean.crossJoin(top("n", "k").withColumnRenamed("ks", "shortest")).crossJoin(top(F.desc("n"), "k").withColumnRenamed("ks", "longest"))


def by_stage(df: DataFrame, stages: list[str], column: str = "model_name") -> DataFrame:
    """Rows with their place in the list of stages; others go."""
    order = df.sparkSession.createDataFrame(list(enumerate(stages)), "stage int, __name string")
    return df.join(F.broadcast(order), F.col(column) == F.col("__name")).drop("__name")
