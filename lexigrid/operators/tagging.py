"""A first-order tagger: tables counted from labelled words, and the best label sequence of each sentence by Viterbi decoding.

Scores are whole numbers, a million times the natural logarithm of a smoothed share, so that a sum is the same in any
order and in any engine, and ties are ties.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrid.session import scratch

UNIT = 1_000_000
#: Added to every count.
PRIOR = 0.1
#: Most labels of a tagger: its transitions go to every task.
MOST_LABELS = 4096
#: The most frequent words, at most so many and with at most so many scores, are broadcast; the others are joined.
MOST_KNOWN, KNOWN_SCORES = 200_000, 4_000_000
#: Scores that a task holds at once, if they are not those of a single sentence.
TASK_SCORES = 4_000_000


@dataclass(frozen=True)
class Tagger:
    """labels: names in order; starts, unknown: a score a label; moves: from, to; words: (word, n, scores array<int>).

    seen: (word, label number, score), a row for each label that a word has; ``words`` is the same in full, n being how often a word was seen.
    """

    labels: list[str]
    starts: list[int]
    moves: list[list[int]]
    unknown: list[int]
    words: DataFrame
    seen: DataFrame


def log_share(n: Column, total: Column, kinds: Column, prior: float = PRIOR) -> Column:
    """floor of UNIT * ln((n + prior) / (total + prior * kinds))."""
    return F.floor(F.log((n + F.lit(prior)) / (total + F.lit(prior) * kinds)) * UNIT).cast("int")


def _log_share(n: int, total: int, kinds: int) -> int:
    return math.floor(math.log((n + PRIOR) / (total + PRIOR * kinds)) * UNIT)


def fit_tagger(rows: DataFrame, by: list[str], pos: str = "pos", word: str = "word", label: str = "label") -> Tagger:
    """Counts word rows (by, pos, word, label): which label a sentence starts with, follows another, and has which words.

    Rows without a label or word are left out; a label that follows a gap follows the last one before it. Words that were
    not seen with a label, or at all, count as one more kind of word. There must be at most MOST_LABELS labels, as each
    pair of them has a score; words may be many and stay a table.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(word).isNotNull()).select(*by, F.col(pos).alias("pos"), F.col(word).alias("word"), F.col(label).alias("label"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"])
    return _fit(known.select("word", "label"), known.groupBy(*by).agg(in_order.alias("ls")).select("ls"))


def fit_sentences(sentences: DataFrame, words: str | Column = "words", labels: str = "labels") -> Tagger:
    """``fit_tagger`` of whole sentences, a row each, with arrays of their words (a column or what makes it) and labels: no word is shuffled to its sentence."""
    words = F.col(words) if isinstance(words, str) else words
    pairs = sentences.select(F.inline(F.arrays_zip(words.alias("word"), F.col(labels).alias("label"))).alias("word", "label"))
    known = F.zip_with(words, labels, lambda w, x: F.when(w.isNotNull(), x))
    return _fit(pairs.where(F.col("word").isNotNull() & F.col("label").isNotNull()), sentences.select(known.alias("ls")))


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of a task's lists: how often label b follows label a, or starts a list (a null). Null labels are passed over."""
    found: Counter = Counter()
    for batch in batches:
        flat, owner = batch.column(0).flatten(), pc.list_parent_indices(batch.column(0))
        real = flat.is_valid()
        coded, owner = flat.filter(real).dictionary_encode(), owner.filter(real).to_numpy(zero_copy_only=False)
        names, codes = [None, *coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        before = np.where(np.diff(owner, prepend=-1) > 0, 0, np.concatenate((np.zeros(1, np.int64), codes))[:-1])
        pairs, n = np.unique(before * len(names) + codes, return_counts=True)
        for x, k in zip(pairs.tolist(), n.tolist(), strict=True):
            found[names[x // len(names)], names[x % len(names)]] += k
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["a", "b", "n"])


def _fit(pairs: DataFrame, lists: DataFrame) -> Tagger:
    """A tagger of (word, label) rows and of the labels of each sentence in order."""
    spark, path = pairs.sparkSession, scratch(pairs.sparkSession, "emitted")
    emitted = pairs.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))
    emitted.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("label", "n")).alias("found")).write.parquet(path)
    emitted = spark.read.parquet(path)  # a row for each word: what follows looks at it without dealing words anew
    totals = emitted.select(F.inline("found").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("total")).orderBy("label").limit(MOST_LABELS + 1).collect()
    if len(totals) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels, k = [r["label"] for r in totals], len(totals)
    if not labels:
        return Tagger([], [], [], [], spark.createDataFrame([], "word string, n long, scores array<int>"), spark.createDataFrame([], "word string, label int, score int"))
    kinds = emitted.count() + 1
    steps = lists.mapInArrow(_followers, "a string, b string, n long")
    moved = {(r["a"], r["b"]): r["n"] for r in steps.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}  # at most a number for each pair
    sums: Counter = Counter()
    for (a, _), n in moved.items():
        sums[a] += n

    def score(a: str | None) -> list[int]:
        return [_log_share(moved.get((a, b), 0), sums[a], k) for b in labels]

    of = F.broadcast(spark.createDataFrame([(r["label"], n, r["total"]) for n, r in enumerate(totals)], "label string, number int, total long"))
    seen = emitted.select("word", F.inline("found").alias("label", "n")).join(of, "label").select("word", F.col("number").alias("label"), log_share(F.col("n"), F.col("total"), F.lit(kinds)).alias("score"))
    unknown = [_log_share(0, r["total"], kinds) for r in totals]
    every = F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.lit(r["total"]).alias("total"), F.lit(u).alias("unknown")) for r, u in zip(totals, unknown, strict=True)])
    n = F.map_from_entries("found")
    scores = F.transform(every, lambda x: F.coalesce(log_share(F.try_element_at(n, x["label"]), x["total"], F.lit(kinds)), x["unknown"]))
    return Tagger(labels, score(None), [score(a) for a in labels], unknown, emitted.select("word", "n", scores.alias("scores")), seen)


def frequent_words(tagger: Tagger) -> pa.Table:
    """(word, scores) of the tagger's most frequent words, within MOST_KNOWN and KNOWN_SCORES: words of one count, by eighths of a power of two, stay together."""
    left, least = min(MOST_KNOWN, KNOWN_SCORES // len(tagger.labels)), None
    step = F.floor(F.log2("n") * 8)
    for r in tagger.words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 512 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return tagger.words.where(F.lit(False) if least is None else step >= least).select("word", "scores").toArrow()


def viterbi_all(scores: np.ndarray, sizes: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best paths of sentences of some sizes, at least 1, whose words' scores follow each other: labels as numbers, and a score a sentence.

    Sentences go step by step together, the longest first. Of equal paths the one whose last label that differs has the smaller number.
    """
    n, k = scores.shape
    path, best = np.zeros(n, np.int64), np.zeros((len(sizes), k), np.int64)
    back, order, starting = np.zeros((n, k), np.uint16), np.argsort(-sizes, kind="stable"), np.cumsum(sizes) - sizes
    together = max(1, TASK_SCORES // (k * k))
    for lo in range(0, len(order), together):
        own = order[lo : lo + together]
        begin, longest = starting[own], int(sizes[own[0]])
        live = np.searchsorted(-sizes[own], -np.arange(longest), side="left")  # sentences longer than each place
        now = starts + scores[begin]
        for t in range(1, longest):
            m = live[t]
            at = begin[:m] + t
            both = now[:m, :, None] + moves
            came = both.argmax(1)
            back[at] = came
            now[:m] = np.take_along_axis(both, came[:, None], 1)[:, 0] + scores[at]
        best[own] = now
        label = now.argmax(1)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            at = begin[:m] + t
            path[at] = label[:m]
            label[:m] = back[at, label[:m]]
    return path, best.max(1)


def viterbi(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, int]:
    """The best path's labels, as numbers, and its score. Of equal paths the one whose last label that differs has the smaller number."""
    path, best = viterbi_all(scores, np.array([len(scores)]), starts, moves)
    return path, int(best[0])


def decode(rows: DataFrame, tagger: Tagger, by: list[str], pos: str = "pos", word: str = "word") -> DataFrame:
    """M2, M6: (by, pos, word, pred_label, best_score): the best label sequence of each sentence, and its score.

    Words are gathered by sentence and tagged by ``decode_sentences``. Words that the tagger does not know, nulls too, have
    the scores of the unknown. A tagger without labels gives null labels. Repeated places count as words of their own, in the
    order of the word.
    """
    if not tagger.labels:
        return rows.select(*by, F.col(pos).alias("pos"), F.col(word).alias("word"), F.lit(None).cast("string").alias("pred_label"), F.lit(None).cast("long").alias("best_score"))
    own = rows.select(*by, F.col(pos).cast("long").alias("pos"), F.col(word).alias("word"))
    of_sentence = own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("x")).select(*by, F.col("x.pos").alias("places"), F.col("x.word").alias("words"))
    tagged = decode_sentences(of_sentence, tagger, by, keep=["places", "words"])
    return tagged.select(*by, F.inline(F.arrays_zip("places", "words", "pred_labels")).alias("pos", "word", "pred_label"), "best_score")


def decode_sentences(sentences: DataFrame, tagger: Tagger, by: list[str], words: str | Column = "words", keep: Sequence[str] = ()) -> DataFrame:
    """(by, keep, pred_labels, best_score) of whole sentences, a row each: ``by`` names a sentence, null being a name too.

    Words are an array column, or what makes it of others: then those are shuffled, a text say, and split behind the join.

    The scores of frequent words are broadcast. Of the other words, each sentence's are joined once with the labels that
    they were seen with and brought to the sentence, so that no word is shuffled with its scores. A task holds some
    TASK_SCORES scores or those of one sentence. A sentence without words has no score; a tagger without labels gives nulls.
    """
    if not tagger.labels:
        return sentences.select(*by, *keep, F.lit(None).cast("array<string>").alias("pred_labels"), F.lit(None).cast("long").alias("best_score"))
    spark, k = sentences.sparkSession, len(tagger.labels)
    words = F.col(words) if isinstance(words, str) else words
    known = frequent_words(tagger)
    shared = spark.sparkContext.broadcast((
        tagger.labels, np.array(tagger.starts), np.array(tagger.moves), np.array(tagger.unknown),
        known.column("word").combine_chunks(), known.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, k),
    ))
    frequent = F.broadcast(spark.createDataFrame(known.select(["word"])))
    rare = sentences.select(*by, F.explode(F.array_distinct(words)).alias("word")).join(frequent, "word", "left_anti").join(tagger.seen, "word")
    rare = rare.groupBy(*by).agg(F.collect_list(F.struct("word", "label", "score")).alias("rare")).withColumnsRenamed({c: f"__{c}" for c in by})
    same = [sentences[c].eqNullSafe(rare[f"__{c}"]) for c in by]
    both = sentences.join(rare, same, "left").select(*by, *keep, words.alias("__words"), "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, starts, moves, unknown, frequent, known = shared.value
        names = pa.array(labels)

        def tagged(batch: pa.RecordBatch) -> pa.RecordBatch:
            column, rare = batch.column("__words"), batch.column("rare").flatten()
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = column.flatten().dictionary_encode()
            kinds = coded.dictionary
            scores = np.tile(unknown, (len(kinds) + 1, 1))  # the last row is that of nulls
            at = pc.index_in(kinds, value_set=frequent).fill_null(-1).to_numpy(zero_copy_only=False)
            scores[:-1][at >= 0] = known[at[at >= 0]]
            word, label, score = rare.flatten()
            scores[pc.index_in(word, value_set=kinds).to_numpy(zero_copy_only=False), label.to_numpy(zero_copy_only=False)] = score.to_numpy(zero_copy_only=False)
            codes = coded.indices.fill_null(len(kinds)).to_numpy(zero_copy_only=False)
            real = sizes > 0
            path, best = viterbi_all(scores[codes], sizes[real], starts, moves)
            total = np.zeros(len(sizes), np.int64)
            total[real] = best
            tags = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), names.take(pa.array(path)))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, *keep)), tags, pa.array(total, mask=~real)], names=[*by, *keep, "pred_labels", "best_score"])

        for batch in batches:
            upto = np.cumsum(pc.list_value_length(batch.column("__words")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) * k
            at = 0
            while at < batch.num_rows:
                done = int(upto[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(upto, done + TASK_SCORES, side="right")))
                yield tagged(batch.slice(at, to - at))
                at = to

    out = T.StructType([both.schema[c] for c in (*by, *keep)]).add("pred_labels", T.ArrayType(T.StringType())).add("best_score", T.LongType())
    return both.mapInArrow(run, out)
