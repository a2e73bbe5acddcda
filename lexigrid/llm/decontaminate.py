"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment (operator 10).

Every item gives its n-grams of SEED words; their corpus frequencies are counted over all documents. An
alignment that is similar enough leaves a known number of a passage's n-grams whole (see ``least_whole``),
and whole ones occur in the corpus, so of those that occur the rarest are seeds, as many as make sure that
one at least is whole in every such alignment. Seeds found in a document join it to passages; of these,
passages with enough n-grams near one diagonal are scored by Smith-Waterman over words against the part of
the document around them. No step loses an alignment. Items are taken in blocks of bounded size, each
broadcast, against all documents.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import map_chunks, text_function

#: Words in a seed: an alignment at SIMILARITY may leave no run of three words whole, but always one of two.
SEED = 2
#: Share of an item's words (or of MOST_WORDS, for longer items) that must be aligned, and matched words in the aligned part.
SIMILARITY = 0.8
#: Fixed values of the alignment: match, mismatch, gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Longer items are taken as overlapping passages of this many words, each scored by itself.
PASSAGE = 50
#: Items, and bytes of their texts, in a block on average; each block is broadcast on its own.
BLOCK_ITEMS = 5_000
BLOCK_BYTES = 8 << 20
FLUSH = 200_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: letters, digits and bytes above ASCII; everything else separates."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def passages(words: list[bytes], size: int = PASSAGE) -> list[list[bytes]]:
    """The item itself if it has at most ``size`` words, else overlapping passages that cover it."""
    if len(words) <= size:
        return [words] if words else []
    starts = [*range(0, len(words) - size, size // 2), len(words) - size]
    return [words[s : s + size] for s in starts]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment of two sequences of word ids: (score, matched, aligned words of a, start in b, end in b).

    Negative ids match nothing. Of equal scores the first end in a, then in b, is taken.
    """
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1), np.int32)
    step = np.arange(m + 1, dtype=np.int32) * -GAP
    for i in range(1, n + 1):
        same = (b == a[i - 1]) & (a[i - 1] >= 0)
        best = np.maximum(score[i - 1, :-1] + np.where(same, MATCH, MISMATCH), score[i - 1, 1:] + GAP)
        row = np.concatenate(([0], np.maximum(best, 0)))
        score[i] = np.maximum.accumulate(row + step) - step  # gaps along b in one pass
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    best, end, matched, last = int(score[i, j]), int(j), 0, int(i)
    while i and j and score[i, j] > 0:
        same = a[i - 1] >= 0 and a[i - 1] == b[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += int(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, matched, last - int(i), int(j), end


class Items:
    """A block of items: passages as word ids, and what each n-gram of theirs belongs to."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.word_ids: dict[bytes, int] = {}
        self.parts: list[tuple[int, np.ndarray]] = []
        self.grams: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item, text in rows:
            for words in passages(words_of(text)):
                ids = [self.word_ids.setdefault(w, len(self.word_ids)) for w in words]
                for k in range(max(1, len(ids) - SEED + 1)):
                    self.grams[tuple(ids[k : k + SEED])].append((len(self.parts), k))
                self.parts.append((item, np.array(ids, np.int64)))
        short = {g for g in self.grams if len(g) < SEED}
        self.whole = sorted(short, key=len)

    def code(self, gram: tuple) -> int:
        base, code = len(self.word_ids) + 1, 0
        for w in gram:
            code = code * base + w + 1
        return code % (1 << 62)

    def of_text(self, text: str | None) -> np.ndarray:
        get = self.word_ids.get
        words = words_of(text)
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def codes(self, ids: np.ndarray, width: int) -> np.ndarray:
        """Code of the n-gram at each place, 0 where a word is unknown."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        base, code, ok = len(self.word_ids) + 1, np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(width):
            w = ids[k : k + n]
            code = code * base + w + 1
            ok &= w >= 0
        return np.where(ok, code % (1 << 62), 0)


def least_whole(n: int, similarity: float) -> int:
    """The fewest n-grams of SEED = 2 words that an alignment with a passage of ``n`` words leaves whole.

    m matched words in a part of L words of the document, with m >= similarity * n and m >= similarity * L,
    stand in at most 1 + (n - m) + (L - m) runs, and a run of r words holds r - 1 n-grams. The bound is above
    zero for any similarity of 0.8 or more; below that one n-gram is asked for.
    """
    return max(1, math.ceil(n * (3 * similarity - 2) - 1 - 1e-9))


def seeds_of(items: Items, frequency: dict[int, int], similarity: float = SIMILARITY) -> dict[int, list[int]]:
    """Code of each seed, with its passages: of a passage's n-grams that occur in documents the rarest, all but least_whole - 1."""
    chosen: dict[int, list[int]] = defaultdict(list)
    for part, (_, words) in enumerate(items.parts):
        codes = sorted((c for c in items.codes(words, SEED).tolist() if c in frequency), key=lambda c: (frequency[c], c))
        for c in dict.fromkeys(codes[: max(0, len(codes) - least_whole(len(words), similarity) + 1)]):
            chosen[c].append(part)
    return dict(chosen)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, similarity, matched, start_word, end_word): one row for each document and item that it holds.

    similarity is the matched words of the best alignment, as a share of the passage's words; items of
    over PASSAGE words are held if one of their passages is. Words are compared in lower case without
    punctuation. Null and empty texts and items match nothing; items of one or two words must stand there
    whole. Repeated items with the same id count once, by their best passage; of passages that tie the first stands. Repeated
    documents give repeated rows, null ids too. Texts are read whole, however long. With an empty benchmark or no documents
    there are no rows. Other columns are ignored, whatever their names.

    From a similarity of 0.8 on no alignment is lost. Below it an alignment may leave no two words of a passage together, and such
    ones are not found.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    ddl = f"`{id_col}` {id_type}, `{item_col}` {item_type}, similarity double, matched long, start_word long, end_word long"
    out = None
    for rows in item_blocks(benchmark, item_col, item_text_col):
        shared, seeds = prepare(docs, Items(rows), text_col, similarity)

        def setup(shared=shared, seeds=seeds):
            find = finder(shared.value, seeds.value, similarity)

            def f(ids: list | None = None, texts: list | None = None):
                if ids is not None and (rows := [(i, *x) for i, t in zip(ids, texts, strict=True) for x in find(t)]):
                    yield tuple(map(list, zip(*rows, strict=True)))

            return f

        found = map_chunks(docs, [F.col(id_col), F.col(text_col)], ddl, setup)
        out = found if out is None else out.union(found)
    return out


def item_blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple]]:
    """The distinct items in blocks of about BLOCK_ITEMS rows and BLOCK_BYTES, chosen by hash; one empty block if there are none."""
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    rows, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r["item"], r["text"]) for r in part.toLocalIterator()]


def prepare(docs: DataFrame, items: Items, text_col: str, similarity: float):
    """A block's items and its seeds, both broadcast; the corpus frequencies come from all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count_setup():
        block: Items = shared.value
        all_codes = np.array(sorted(block.code(g) for g in block.grams if len(g) == SEED), np.int64)
        kept: Counter = Counter()

        def f(texts: list | None = None):
            if texts is None:
                yield list(kept), list(kept.values())
                return
            for t in texts:
                got = block.codes(block.of_text(t), SEED)
                got = got[got > 0]
                if len(got) and len(all_codes):
                    at = np.minimum(np.searchsorted(all_codes, got), len(all_codes) - 1)
                    kept.update(np.unique(got[all_codes[at] == got]).tolist())
            if len(kept) > FLUSH:
                yield list(kept), list(kept.values())
                kept.clear()

        return f

    counted = map_chunks(docs, [F.col(text_col)], "code long, n long", count_setup).groupBy("code").agg(F.sum("n").alias("n"))
    frequency = {r["code"]: r["n"] for r in counted.toLocalIterator()}  # n-grams of one block: under BLOCK_ITEMS times its words
    seeds = docs.sparkSession.sparkContext.broadcast(seeds_of(items, frequency, similarity))
    return shared, seeds


def finder(block: Items, chosen: dict[int, list[int]], similarity: float):
    """A function from a text to its held items: sorted (item, similarity, matched, start word, end word)."""
    rare = np.array(sorted(chosen), np.int64)
    narrow = {w: np.array(sorted(block.code(g) for g in block.whole if len(g) == w), np.int64) for w in {len(g) for g in block.whole}}
    whole = {block.code(g): block.grams[g] for g in block.whole}
    own = [block.codes(words, SEED) for _, words in block.parts]
    least = np.array([least_whole(len(words), similarity) for _, words in block.parts], np.int64)
    def near_seeds(ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(passage, sorted starts) of the passages that can be held: with a seed, and enough n-grams near one diagonal.

        What each seeded passage shares with the text is counted before any of it is written out, and then written out
        for one passage at a time, so that memory does not grow with what many items have in common.
        """
        got = block.codes(ids, SEED)
        if not len(got) or not len(rare):
            return
        at = np.minimum(np.searchsorted(rare, got), len(rare) - 1)
        seeds = np.unique(got[rare[at] == got]).tolist()
        if not seeds:
            return
        seeded = np.unique(np.concatenate([chosen[c] for c in seeds]))
        places = np.argsort(got, kind="stable")
        ordered = got[places]
        codes, sizes = np.concatenate([own[p] for p in seeded.tolist()]), np.array([len(own[p]) for p in seeded.tolist()])
        lo = np.searchsorted(ordered, codes)
        n, of = np.searchsorted(ordered, codes, "right") - lo, np.repeat(np.arange(len(seeded)), sizes)
        shared, begins = np.bincount(of, n, len(seeded)).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))
        for k in np.flatnonzero(shared >= least[seeded]).tolist():
            p, own_n = int(seeded[k]), n[begins[k] : begins[k + 1]]
            entry = np.repeat(lo[begins[k] : begins[k + 1]] - np.cumsum(own_n) + own_n, own_n) + np.arange(own_n.sum())
            starts = np.sort(places[entry] - np.repeat(np.arange(sizes[k]), own_n))
            more, width = int(least[p]) - 1, len(block.parts[p][1]) // 2 + 1  # gaps that an alignment can have, and one more
            first = np.flatnonzero(starts[more:] - starts[: len(starts) - more] <= width)
            if len(first):
                inside = np.zeros(len(starts) + 1, np.int64)
                np.add.at(inside, first, 1)
                np.add.at(inside, first + more + 1, -1)
                yield p, np.unique(starts[np.cumsum(inside)[:-1] > 0]).tolist()

    def short_items(ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """The places of items that have fewer words than a seed."""
        for width, short in narrow.items():
            got = block.codes(ids, width)
            hits = np.flatnonzero(np.isin(got, short))
            for code in np.unique(got[hits]).tolist():
                for part, k in whole[code]:
                    yield part, (hits[got[hits] == code] - k).tolist()

    def of_text(text: str | None) -> list[tuple]:
        ids = block.of_text(text)
        best: dict = {}
        for part, starts in itertools.chain(near_seeds(ids), short_items(ids)):
            item, words = block.parts[part]
            n, at = len(words), -len(words) * 2 - 9
            slack = max(4, n // 4)
            for s in sorted(starts):
                if s <= at:
                    continue  # the last region held this start too
                lo, hi = max(0, s - slack), min(len(ids), s + n + 2 * slack)
                at = s + slack
                _, matched, _, b, e = align(words, ids[lo:hi])
                share = matched / n
                if share >= similarity and matched >= similarity * (e - b) and share > best.get(item, (0,))[0]:
                    best[item] = (share, matched, lo + b, lo + e)
        return sorted((item, *x) for item, x in best.items())

    return of_text


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no benchmark item; nothing is shuffled.

    Null and empty texts hold nothing and stay, repeated rows go or stay together, and all rows stay if there
    are no items. An empty table stays empty.
    """
    for rows in item_blocks(benchmark, item_col, item_text_col):
        shared, seeds = prepare(docs, Items(rows), text_col, similarity)

        def setup(shared=shared, seeds=seeds):
            find = finder(shared.value, seeds.value, similarity)
            return lambda texts: ([bool(find(t)) for t in texts],)

        docs = docs.where(~text_function("held boolean", setup)(F.col(text_col))["held"])
    return docs
