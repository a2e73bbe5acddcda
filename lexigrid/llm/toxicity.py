"""Toxicity by nearest labelled examples (operator 9).

Examples are a bounded, documented sample of labelled rows, in which copies of a text count once. Two block-max
inverted indexes hold them under TF-IDF. The first has marks: words and starts of words that are associated with
the label, for or against it, by a likelihood-ratio test at the 5 % level. The second has all words, whatever
the label, of the examples without a mark. A text with a mark has its neighbours in the first index, any other
text in the second. A search visits blocks in order of their upper bound and stops when no block can enter the
nearest K, so the exact cosine neighbours are found.
Votes are weighted by distance, with the label's share among an index's examples as prior.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import cut, fold, hash_order, map_chunks, text_function

#: Labelled rows that the classifier is fitted on (expected number; fixed by a hash of the id).
SAMPLE_ROWS = 20_000
#: Least examples that a term stands in.
LEAST_ROWS = 5
#: A mark's likelihood ratio is above this: the 5 % level of chi-squared with one degree of freedom.
LEAST_RATIO = 3.84
#: Words in the shingles by which copies in the sample are found, so that they count once.
COPY_SHINGLE = 5
COPY_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Lengths of word starts that are tested besides the words.
STARTS = (3, 4, 5)
NEIGHBOURS = 15
BLOCK = 256
#: Blocks of the largest upper bounds that a search reads first.
FIRST_BLOCKS = 8
#: Terms in more than this share of an index's examples are held as rows over all examples, not as lists.
COMMON_SHARE = 1 / 16
#: Scores are added up in single precision; all that may be among the nearest by this margin are scored again in double.
MARGIN = 1e-4
#: Weight of the prior in the vote, and what is added to a distance before its inverse is taken.
PRIOR_WEIGHT = 1.0
SOFTEN = 0.1
REJECT = 0.7
CACHE = 200_000

find_words = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in STARTS if len(word) > n)]


def counts_of(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, k in Counter(find_words((text or "").lower())).items():
        for t in terms_of(w):
            out[t] += k
    return out


def term_rows(rows: DataFrame) -> DataFrame:
    """(term, rows with label 1, rows with label 0) over columns text and label."""

    def setup():
        kept = ({}, {})

        def give():
            names = list(kept[0].keys() | kept[1].keys())
            if names:
                yield names, [kept[1].get(t, 0) for t in names], [kept[0].get(t, 0) for t in names]
            kept[0].clear()
            kept[1].clear()

        def f(texts: list | None = None, labels: list | None = None):
            if texts is None:
                yield from give()
                return
            for text, label in zip(texts, labels, strict=True):
                mine = kept[label]
                for t in {t for w in set(find_words((text or "").lower())) for t in terms_of(w)}:
                    mine[t] = mine.get(t, 0) + 1
            if len(kept[0]) + len(kept[1]) > CACHE:
                yield from give()

        return f

    counted = map_chunks(rows, [F.col("text"), F.col("label")], "term string, yes long, no long", setup)
    return counted.groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def copy_keys(text: str | None) -> list[int]:
    """The least hash of a text's shingles in each of COPY_KEYS orders: near copies share one or more, other texts don't."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = [b" ".join(words[k : k + COPY_SHINGLE]) for k in range(max(1, len(words) - COPY_SHINGLE + 1))]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64, len(joined))
    return [int((hashes * np.uint64(odd)).min() >> np.uint64(1)) for odd in COPY_KEYS]


def without_copies(rows: DataFrame) -> DataFrame:
    """The sampled rows (id, label, text) without those that share a key with a row of smaller id, key after key."""
    names = [f"k{j}" for j in range(len(COPY_KEYS))]
    keys = text_function(", ".join(f"{n} long" for n in names), lambda: lambda texts: list(zip(*map(copy_keys, texts), strict=True)) or [[]] * len(names))
    left = rows.select("id", keys(F.col("text")).alias("x")).select("id", "x.*")
    for n in names:
        left = left.groupBy(n).agg(F.min(F.struct("id", *names)).alias("x")).select("x.*")
    return rows.join(left.select("id"), "id", "left_semi")


def likelihood_ratio(yes, no, all_yes, all_no):
    """The G-squared statistic of a term's two-by-two table, as a column."""
    total = all_yes + all_no
    share = (yes + no) / total
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return 2 * (part(yes, all_yes * share) + part(no, all_no * share) + part(all_yes - yes, all_yes * (1 - share)) + part(all_no - no, all_no * (1 - share)))


class BlockMax:
    """Block-max inverted index of unit vectors, given as (term numbers, weights) and in the order of their ids.

    Vectors are held in the order of their heaviest common term, so that a block's vectors are alike.
    """

    def __init__(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        n = self.n = len(vectors)
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        terms = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in vectors)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        count = np.bincount(terms, minlength=n_terms)
        common = np.flatnonzero(count > n * COMMON_SHARE)
        self.common_of = np.full(n_terms, -1, np.int32)
        self.common_of[common] = np.arange(len(common))
        owner = np.repeat(np.arange(n), sizes)
        heavy = np.zeros(n, np.int64)
        among = np.flatnonzero(self.common_of[terms] >= 0)
        among = among[np.argsort(weights[among], kind="stable")]
        heavy[owner[among]] = terms[among]  # the last, heaviest one stays
        self.name = np.lexsort((np.arange(n), heavy))  # of each place the vector's number
        place = np.empty(n, np.int64)
        place[self.name] = np.arange(n)
        at = place[owner]
        by = np.lexsort((terms, at))
        self.own_terms, self.own_weights, self.own_starts = terms[by], weights[by], np.concatenate(([0], np.cumsum(sizes[self.name])))
        is_common = self.common_of[terms] >= 0
        self.dense = np.zeros((len(common), n), np.float32)
        self.dense[self.common_of[terms[is_common]], at[is_common]] = weights[is_common]
        terms, at, weights = terms[~is_common], at[~is_common], weights[~is_common]
        by = np.lexsort((at, terms))
        terms, self.at, self.weight = terms[by], at[by].astype(np.int32), weights[by].astype(np.float32)
        blocks = self.blocks = -(-n // BLOCK)
        rows = np.unique(terms)
        self.row_of = np.full(n_terms, -1, np.int32)
        self.row_of[rows] = np.arange(len(rows))
        cell = self.row_of[terms].astype(np.int64) * blocks + self.at // BLOCK
        # of each term's list, where each block begins, and its largest weight there
        self.starts = np.searchsorted(cell, np.arange(len(rows) * blocks + 1)).astype(np.int32)
        self.most = np.zeros(len(rows) * blocks, np.float32)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(len(rows), blocks)
        self.edges = np.arange(0, n, BLOCK)
        self.query = np.zeros(n_terms)

    def nearest(self, queries: Sequence[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """Of each query the k vectors with the largest cosine above zero, as (cosine, number); ties go to the first number."""
        if not self.n:
            return [[] for _ in queries]
        wide = np.zeros((len(queries), len(self.dense)), np.float32)
        for row, (terms, weights) in zip(wide, queries, strict=True):
            at = self.common_of[terms]
            row[at[at >= 0]] = weights[at >= 0]
        base = wide @ self.dense
        return [self._nearest(own, terms, weights, k) for own, (terms, weights) in zip(base, queries, strict=True)]

    def _nearest(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``scores`` has what common terms give to each place, and gets what the others give."""
        rows = self.row_of[terms]
        rare = rows >= 0
        rows, light = rows[rare].astype(np.int64), weights[rare].astype(np.float32)
        bound = np.maximum.reduceat(scores, self.edges)
        if len(rows):
            bound += light @ self.most[rows]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        if not len(order):
            return []
        first, rest = order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]
        found = self._read(scores, rows, light, np.sort(first), k, 0.0)
        if len(found) >= k:  # a block that can't reach the worst of the best is left out
            least = np.partition(scores[found], len(found) - k)[len(found) - k] - MARGIN
            rest = rest[bound[rest] >= least]
        else:
            least = 0.0
        if len(rest):
            found = np.concatenate((found, self._read(scores, rows, light, np.sort(rest), k, least)))
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k] - MARGIN]
        self.query[terms] = weights
        lo = self.own_starts[found]
        n = self.own_starts[found + 1] - lo
        ends = np.cumsum(n)
        entry = np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        exact = np.round(np.add.reduceat(self.query[self.own_terms[entry]] * self.own_weights[entry], ends - n), 12) if len(found) else np.zeros(0)
        self.query[terms] = 0
        number = self.name[found]
        best = np.lexsort((number, -exact))[:k]
        return [(s, j) for s, j in zip(exact[best].tolist(), number[best].tolist(), strict=True) if s > 0]

    def _read(self, scores: np.ndarray, rows: np.ndarray, light: np.ndarray, blocks: np.ndarray, k: int, least: float) -> np.ndarray:
        """Adds what lists give in some blocks; their places that may be among the k best. Neighbouring blocks are read as one run."""
        edge = np.flatnonzero(np.diff(blocks) != 1) + 1
        first, last = blocks[np.concatenate(([0], edge))], blocks[np.concatenate((edge - 1, [len(blocks) - 1]))]
        lo = self.starts[rows[:, None] * self.blocks + first].ravel().astype(np.int64)
        n = self.starts[rows[:, None] * self.blocks + last + 1].ravel() - lo
        if total := int(n.sum()):
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(total)
            scores += np.bincount(self.at[entry], self.weight[entry] * np.repeat(np.repeat(light, len(first)), n), minlength=self.n)
        places = np.concatenate([np.arange(a * BLOCK, min((b + 1) * BLOCK, self.n)) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        found = places[scores[places] > max(least, 0.0)]
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k] - MARGIN]
        return found


class Index:
    """Examples (id, label, {term: count}) under marks and under words, each with the rows that a term stands in."""

    def __init__(self, marks: dict[str, int], words: dict[str, int], total: int, examples: Iterable[tuple]) -> None:
        self.marks, self.words = ({t: k for k, t in enumerate(x)} for x in (marks, words))
        self.idf = [np.array([math.log(1 + total / n) for n in x.values()]) for x in (marks, words)]
        self.ids, self.labels, vectors, self.blank = ([], []), ([], []), ([], []), [0, 0]
        for doc, label, counts in examples:
            part, vector = self.place(counts)
            if vector is None:
                self.blank[label] += 1
                continue
            self.ids[part].append(doc)
            self.labels[part].append(label)
            vectors[part].append(vector)
        self.parts = [BlockMax(v, len(i)) for v, i in zip(vectors, self.idf, strict=True)]
        seen, yes = len(self.labels[0]) + len(self.labels[1]) + sum(self.blank), sum(map(sum, self.labels)) + self.blank[1]
        self.prior = yes / seen if seen else 0.0
        plain = (sum(self.labels[1]) + self.blank[1], len(self.labels[1]) + sum(self.blank))  # of the examples without a mark
        self.priors = self.prior, (plain[0] + PRIOR_WEIGHT * self.prior) / (plain[1] + PRIOR_WEIGHT)
        self.starts = [(n, {t[1:]: k for t, k in self.marks.items() if len(t) == n + 1 and t[0] == "^"}) for n in STARTS]
        self.voted: dict[tuple, tuple] = {}

    def vector(self, part: int, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(counts, np.int32, len(counts))
        weights = (1 + np.log(np.fromiter(counts.values(), float, len(counts)))) * self.idf[part][terms]
        return terms, weights / math.sqrt(weights @ weights)

    def place(self, counts: dict[str, int]) -> tuple[int, tuple | None]:
        """The index that counts of terms belong in, and their unit vector there, or None if no term is known."""
        for part, of in enumerate((self.marks, self.words)):
            if own := {of[t]: k for t, k in counts.items() if t in of}:
                return part, self.vector(part, own)
        return 1, None

    def of_text(self, text: str | None) -> tuple[int, tuple | None]:
        """The same for a text."""
        found: dict[int, int] = {}
        words = Counter(find_words((text or "").lower()))
        whole = self.marks.get
        for w, k in words.items():
            if (t := whole(w)) is not None:
                found[t] = k
            for n, of in self.starts:
                if len(w) <= n:
                    break
                if (t := of.get(w[:n])) is not None:
                    found[t] = found.get(t, 0) + k
        if found:
            return 0, self.vector(0, found)
        found = {self.words[w]: k for w, k in words.items() if w in self.words}
        return 1, self.vector(1, found) if found else None

    def scores(self, texts: Sequence[str | None]) -> list[tuple[float, list]]:
        """Of each text the score in [0, 1] and the ids of the neighbours that voted, nearest first."""
        out: list = [(self.priors[1], [])] * len(texts)
        placed: dict[tuple, list[int]] = {}
        for k, text in enumerate(texts):
            part, vector = self.of_text(text)
            if vector is None:
                continue
            key = part, *(x.tobytes() for x in vector)
            if (got := self.voted.get(key)) is not None:
                out[k] = got
            else:
                placed.setdefault(key, []).append(k)
        for part, index in enumerate(self.parts):
            asked = [key for key in placed if key[0] == part]
            for key, near in zip(asked, index.nearest([(np.frombuffer(t, np.int32), np.frombuffer(w)) for _, t, w in asked]), strict=True):
                votes = [(1 / (SOFTEN + 1 - s), j) for s, j in near]
                weight, yes = sum(w for w, _ in votes), sum(w for w, j in votes if self.labels[part][j])
                got = (yes + PRIOR_WEIGHT * self.priors[part]) / (weight + PRIOR_WEIGHT), [self.ids[part][j] for _, j in near]
                for k in placed[key]:
                    out[k] = got
                if not part:  # few terms, so the same vectors come again
                    if len(self.voted) >= CACHE // 10:
                        self.voted.clear()
                    self.voted[key] = got
        return out

    def score(self, text: str | None) -> tuple[float, list]:
        return self.scores([text])[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Index:
    """The index of labelled rows: about ``sample_rows``, fixed by their ids. Null labels are left out.

    Of an id with several labels the largest counts; documents with a repeated id count as often. Null ids match no label.
    An example that shares a minimum hash with one before it is left out, whatever its label. Without labels the index is empty.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    total = marks.count()
    chosen = marks.where(hash_order("id") * total < sample_rows)  # about sample_rows rows, whatever the table
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = cut(without_copies(rows.select("id", "label", "text")))
    n_yes, n_no = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n_yes + n_no:
        return Index({}, {}, 0, [])
    tested = term_rows(rows).withColumn("n", F.col("yes") + F.col("no")).where(F.col("n") >= LEAST_ROWS)
    tested = cut(tested.withColumn("g", likelihood_ratio(F.col("yes"), F.col("no"), float(n_yes), float(n_no))))
    # the terms of a bounded sample
    found = [{r["term"]: r["n"] for r in part.select("term", "n").orderBy("term").toLocalIterator()} for part in (
        tested.where(F.col("g") > LEAST_RATIO), tested.where(~F.col("term").startswith("^")))]
    shared = docs.sparkSession.sparkContext.broadcast([{t: k for k, t in enumerate(x)} for x in found])

    def setup():
        of_marks, of_words = shared.value

        def f(ids: list | None = None, labels: list | None = None, texts: list | None = None):
            if ids is None:
                return
            both = []
            for text in texts:
                counts = Counter(find_words((text or "").lower()))
                marked: Counter = Counter()
                for w, k in counts.items():
                    for t in terms_of(w):
                        if t in of_marks:
                            marked[of_marks[t]] += k
                both.append((0, marked) if marked else (1, {of_words[w]: k for w, k in counts.items() if w in of_words}))
            yield ids, labels, [p for p, _ in both], [list(c) for _, c in both], [list(c.values()) for _, c in both]

        return f

    id_type = docs.schema[id_col].dataType.simpleString()
    vectors = map_chunks(rows, [F.col("id"), F.col("label"), F.col("text")], f"id {id_type}, label int, part int, terms array<int>, counts array<int>", setup)
    kept = [(r[0], r[1], r[2], array("i", r[3]), array("i", r[4])) for r in vectors.toLocalIterator()]
    kept.sort(key=lambda x: (x[0] is None, x[0], *x[1:]))
    names = [list(x) for x in found]
    return Index(*found, n_yes + n_no, ((i, label, {names[part][t]: k for t, k in zip(terms, counts, strict=True)}) for i, label, part, terms, counts in kept))


def score_function(docs: DataFrame, index: Index, id_type: str):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def setup():
        scores = shared.value.scores

        def f(texts: list) -> tuple:
            got = scores(texts)
            return [g[0] for g in got], [int(g[0] >= REJECT) for g in got], [g[1] for g in got]

        return f

    return text_function(f"score double, predicted int, evidence array<{id_type}>", setup)


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, evidence) of every row, from its whole text alone.

    evidence lists the ids of the neighbours, nearest first. Null and empty texts, and texts without any
    word of the sample, get the label's share among the examples without a mark and no evidence; with no
    labelled rows every score is 0. Neighbours that tie go by id. Repeated rows and null ids stay; texts are read whole; an
    empty table gives an empty one; other columns are ignored, whatever their names.
    """
    f = score_function(docs, index, docs.schema[id_col].dataType.simpleString())
    return docs.select(F.col(id_col), f(F.col(text_col)).alias("x")).select(id_col, "x.*")


def drop_toxic(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below REJECT.

    Each row is judged by its own text, so repeated rows and null ids go or stay by it; null and empty texts
    score as in ``score``. An empty table stays empty, and columns of any name are kept.
    """
    f = score_function(docs, index, docs.schema[id_col].dataType.simpleString())
    return docs.where(f(F.col(text_col))["predicted"] == 0)


def held_out(id_col: str = "doc_id"):
    return fold(id_col, 3) == 1
