"""Subwords by longest match in a trie, over pieces counted from words."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.text import MARK

#: What stands for a word that the pieces can't make up.
UNKNOWN = "<unk>"
#: A piece of so many characters at most; so many pieces at most go to every task, some 40 MB as a trie.
LONGEST = 12
MOST_PIECES = 100_000


class Trie:
    """Pieces by their characters; a word's first piece has a mark in front."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.root: dict = {}
        for piece in pieces:
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece

    def longest(self, text: str, at: int) -> str:
        """The longest piece that begins at a place, or nothing."""
        node, found = self.root, ""
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                break
            found = node.get("", found)
        return found

    def word(self, word: str) -> list[str]:
        """A word's pieces, each the longest that begins where the one before ends; the unknown piece if there is a gap."""
        text, at, out = MARK + word, 0, []
        while at < len(text):
            piece = self.longest(text, at)
            if not piece:
                return [UNKNOWN]
            out.append(piece)
            at += len(piece)
        return out

    def __call__(self, text: str) -> list[str]:
        return [p for w in text.split() for p in self.word(w)]


def count_pieces(words: DataFrame, word: str = "word", most: int = MOST_PIECES, longest: int = LONGEST, least: int = 2) -> DataFrame:
    """(piece, n): marked starts and unmarked insides of words up to ``longest`` characters, the ``most`` most frequent ones.

    Distinct words are counted first, so a frequent word is cut into pieces once. Single characters are always in, up to
    ``most``; of the others those seen ``least`` times and more; ties by piece. Null and empty words have none.
    """
    counts = words.where(F.length(word) > 0).groupBy(F.col(word).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    marked = F.concat(F.lit(MARK), F.col("w"))
    starts = F.transform(F.sequence(F.lit(1), F.length(marked)), lambda k: F.substring(marked, F.lit(1), F.least(k, F.lit(longest))))
    inner = F.expr(f"flatten(transform(sequence(1, length(w)), a -> transform(sequence(1, least({longest}, length(w) - a + 1)), n -> substring(w, a, n))))")
    pieces = counts.select("n", F.explode(F.concat(F.array_distinct(starts), inner)).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))
    single = F.length(F.regexp_replace("piece", f"^{MARK}", "")) <= 1
    kept = pieces.where(single | (F.col("n") >= least)).withColumn("single", single)
    return kept.orderBy(F.desc("single"), F.desc("n"), "piece").limit(most).select("piece", "n")


def trie_tokenizer(pieces: DataFrame, most: int = MOST_PIECES) -> Callable[[], Trie]:
    """A ``load`` function over a piece list of bounded size: the trie is built once a task, from a broadcast."""
    rows = pieces.select("piece").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pieces")
    sent = pieces.sparkSession.sparkContext.broadcast(sorted(r[0] for r in rows))
    return lambda: Trie(sent.value)
