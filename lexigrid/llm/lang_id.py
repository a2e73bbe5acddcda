"""Language identification by word-first backoff (operator 6).

A model holds log frequencies of words, and of character n-grams of one to ORDER letters, in each
language. A known word is scored by its own log frequencies; an unseen word falls back to the longest
n-grams it knows at each place, and from there to shorter ones. All words and n-grams of a bounded sample
of rows are kept, which bounds the model whatever the corpus.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import fold, hash_order, map_chunks, text_function

#: Expected rows of each language that the model is fitted on; chosen by a hash of the id.
SAMPLE_ROWS = 4000
#: Longest character n-gram.
ORDER = 4
#: Factor for each step down to a shorter n-gram.
BACKOFF = 0.4
#: Of a word or n-gram that a language doesn't know.
FLOOR = 1e-7
CACHE = 200_000

find_words = re.compile(r"[^\W\d_]+").findall


def has_letter(word: str) -> bool:
    """Whether one character at least is a letter; numerals such as a half or a Roman six are none."""
    return any(map(str.isalpha, word))


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def count_entries(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, kind, entry, n): kind 0 for words, else the n-gram's length. Counted in tasks, then summed."""

    def setup():
        kept: dict[tuple[str, int], Counter] = {}

        def give():
            for (lang, kind), c in kept.items():
                if c:
                    yield [lang] * len(c), [kind] * len(c), list(c), list(c.values())
            kept.clear()

        def f(langs: list | None = None, texts: list | None = None):
            if langs is None:
                yield from give()
                return
            for lang, text in zip(langs, texts, strict=True):
                words = Counter(find_words((text or "").lower()))
                kept.setdefault((lang, 0), Counter()).update(words)
                for n in range(1, ORDER + 1):
                    c = kept.setdefault((lang, n), Counter())
                    for w, k in words.items():
                        for g in grams(w, n):
                            c[g] += k
            if sum(map(len, kept.values())) > CACHE:
                yield from give()

        return f

    counted = map_chunks(rows, [F.col(lang_col), F.col(text_col)], "lang string, kind int, entry string, n long", setup)
    return counted.groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))


class Model:
    """Log10 frequencies: one matrix row of all languages for each entry; row 0 is of what no language knows."""

    def __init__(self, rows: Iterable[tuple[str, int, str, float]]) -> None:
        self.tables: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
        self.fixed, names, of, at, shares = 1, {}, array("i"), array("i"), array("d")
        for lang, kind, entry, share in rows:
            k = self.tables[kind].setdefault(entry, self.fixed)
            self.fixed += k == self.fixed
            of.append(names.setdefault(lang, len(names)))
            at.append(k)
            shares.append(share)
        self.langs = sorted(names)
        self.matrix = np.full((self.fixed, len(names)), math.log10(FLOOR))
        column = np.array([self.langs.index(lang) for lang in names], np.int64)
        if len(at):
            self.matrix[np.array(at), column[np.array(of)]] = np.log10(np.array(shares))
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """The matrix row of a word that the cache doesn't hold: its own, or a new one for an unseen word."""
        k = self.tables[0].get(word)
        if k is None:
            if len(self.matrix) == self.fixed:
                self.matrix = np.vstack((self.matrix, np.zeros((CACHE, len(self.langs)))))
            if self.used == CACHE:
                self.cache.clear()
                self.used = 0
            k = self.fixed + self.used
            self.used += 1
            self.matrix[k] = self.unseen(word)
        self.cache[word] = k
        return k

    used = 0

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the word's places of the longest known n-gram's score, with a step for each letter given up."""
        padded, rows, steps = f" {word} ", [], 0
        for k in range(max(1, len(padded) - ORDER + 1)):
            for n in range(min(ORDER, len(padded) - k), 0, -1):
                row = self.tables[n].get(padded[k : k + n])
                if row is not None:
                    steps += ORDER - n
                    break
            rows.append(row or 0)
        return (self.matrix[rows].sum(axis=0) + steps * math.log10(BACKOFF)) / len(rows)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and posterior (even priors); und if there is no letter or nothing was learned."""
        words = Counter(find_words(text.lower())) if text else None
        if not words or not self.langs or not any(map(has_letter, words)):
            return "und", 0.0
        known, names = self.cache, list(words)
        total, counts = np.zeros(len(self.langs)), np.fromiter(words.values(), float, len(words))
        for s in range(0, len(names), CACHE // 2):
            part = names[s : s + CACHE // 2]
            if self.used + len(part) > CACHE:
                known.clear()
                self.used = 0
            rows = [known.get(w) or self.word(w) for w in part]
            total += counts[s : s + CACHE // 2] @ self.matrix[rows]
        score = total * math.log(10)
        p = np.exp(score - score.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the rows with a language. Each language gives about ``sample_rows`` rows, fixed by their ids.

    Rows that share an id are all in the sample or all out of it; null ids count as one. Null languages are left out, null
    and empty texts teach nothing, and texts are read whole. Without rows the model knows no language."""
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    share = F.broadcast(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    part = rows.join(share, "lang").where(hash_order("id") * F.col("rows") < sample_rows)
    counts = count_entries(part, "lang", "text")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "kind"]).select("lang", "kind", "entry", F.col("n") / F.col("total"))
    return Model(shares.toLocalIterator())  # what sample_rows rows of each language hold


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text alone.

    Null texts and texts without a letter get und and 0. Of languages that score the same the first by
    name is taken. Repeated rows and null ids stay; texts are read whole; an empty table gives an empty one; other columns are
    ignored, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def setup():
        predict = shared.value.predict
        return lambda texts: list(zip(*map(predict, texts), strict=True)) or [[], []]

    return df.select(F.col(id_col), text_function("lang_pred string, score double", setup)(F.col(text_col)).alias("x")).select(id_col, "x.*")


def held_out(id_col: str = "doc_id"):
    return fold(id_col, 4) == 2
