"""Periodic runs of words and texts without their repetitions (operator 12).

A run is a stretch of consecutive words with smallest period q, ``repeats`` times as long as q or longer, that no
neighbouring word extends. Its periods are looked for scale by scale, a scale holding those from B to 2B - 1 words, B a
power of two: a run of such a period holds a block of B words that begins at a multiple of B, and the same block stands
again one period later. So all aligned blocks of a scale go into an automaton over integer sequences, which reads the
document once, and an occurrence B to 2B - 1 words behind its block is a seed that is extended both ways word by word.
In each such window there is one multiple of B, so every word of the document has one seed a scale at most.

Only stretches are read where each word has been seen less than 2B words before: a run has that from its second
period on, so none is lost, and most texts are passed over at most scales.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from zlib import crc32

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import map_chunks

LEAST_WORDS = 6
REPEATS = 4
#: Words compared first when a seed is extended; then twice as many each time.
STEP = 32


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number among the distinct words of its text."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def distances(ids: np.ndarray) -> np.ndarray:
    """How far back each word's last occurrence lies; more than the text is long for a first one."""
    gap = np.full(len(ids), len(ids) + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    gap[order[again + 1]] = order[again + 1] - order[again]
    return gap


def stretches(gap: np.ndarray, block: int, need: int) -> list[tuple[int, int]]:
    """Where ``need`` words and more in a row have a distance under 2 * block, with the words one period before."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gap < 2 * block, [False]))))
    lo, hi = edges[::2], edges[1::2]
    long = hi - lo >= need
    return list(zip(np.maximum(0, lo[long] - 2 * block + 1).tolist(), hi[long].tolist(), strict=True))


class Names:
    """Numbers of the stretches of ``width`` words that begin at each word, equal for equal stretches; widths double."""

    def __init__(self, ids: np.ndarray) -> None:
        self.width, self.at = 1, ids

    def widen(self, width: int) -> np.ndarray:
        while self.width < width:
            n = len(self.at) - self.width
            self.at = np.unique(self.at[:n] * (len(self.at) + 1) + self.at[self.width :], return_inverse=True)[1]
            self.width *= 2
        return self.at


def seeds(names: Names, lo: int, hi: int, block: int) -> list[tuple[int, int]]:
    """(place of an occurrence, place of its aligned block, block to 2 * block - 1 words before) in [lo, hi), in order.

    Keys are sequences of four names of a quarter of the block at most, so that what the automaton falls back to
    after a difference is short however periodic the words are; the document is read once, in as many interleaved parts as a name has words.
    """
    width = max(1, block // 4)
    at, first = names.widen(width)[: hi - width + 1], -(-lo // block) * block
    machine, number, aligned = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, []
    for k in range(first, hi - block + 1, block):
        key = tuple(at[k : k + block - width + 1 : width].tolist())
        if key not in number:
            number[key] = len(number)
            machine.add_word(key, number[key])
        aligned.append(number[key])
    if not aligned:
        return []
    machine.make_automaton()
    found, start = [], first // block
    for part in range(lo, min(lo + width, len(at))):
        for end, which in machine.iter(tuple(at[part::width].tolist())):
            again = part + (end + 1) * width - block
            k = (again - block) // block - start
            if k >= 0 and aligned[k] == which:
                found.append((again, (start + k) * block))
    found.sort()
    return found


def extended(ids: np.ndarray, lo: int, hi: int, period: int) -> tuple[int, int]:
    """The widest stretch around [lo, hi) in which words ``period`` apart are identical."""
    n, step = len(ids), STEP
    while hi < n:
        other = np.flatnonzero(ids[hi : hi + step] != ids[hi - period : min(hi + step, n) - period])
        if len(other):
            hi += int(other[0])
            break
        hi, step = min(hi + step, n), 2 * step
    step = STEP
    while lo > 0:
        low = max(0, lo - step)
        other = np.flatnonzero(ids[low:lo] != ids[low + period : lo + period])
        if len(other):
            lo = low + int(other[-1]) + 1
            break
        lo, step = low, 2 * step
    return lo, hi


def smallest(ids: np.ndarray, lo: int, period: int) -> bool:
    """Whether a stretch of twice the period or more has no smaller period; that one would divide it."""
    left, factor = period, 2
    while left > 1:
        if factor * factor > left:
            factor = left
        if left % factor == 0:
            d = period // factor
            if np.array_equal(ids[lo : lo + period], ids[lo + d : lo + d + period]):
                return False
            while left % factor == 0:
                left //= factor
        factor += 1
    return True


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's word numbers, by start, then period. ``repeats`` is 3 or more.

    Time is in proportion to n log n but for the extensions, which stop at the first difference. Seeds inside a run of
    a smaller scale are passed over: blocks there are at least as long as its period, so the distance is a multiple of
    it and the stretch the same. So are seeds inside the last stretch of their own period.
    """
    if repeats < 3:
        raise ValueError("blocks are found in runs of three periods and more")
    n, block, found = len(ids), 1, set()
    if n < least:
        return []
    gap, names = distances(ids), Names(ids)
    covered = np.zeros(n, np.int64)  # the furthest end of smaller scales' runs around a word
    while repeats * block <= n:
        new = set()
        for lo, hi in stretches(gap, block, max((repeats - 1) * block, least - 2 * block + 1)):
            done: dict[int, int] = {}
            for again, at in seeds(names, lo, hi, block):
                period = again - at
                if again + block <= max(int(covered[at]), done.get(period, 0)):
                    continue
                start, end = extended(ids, at, again + block, period)
                done[period] = end
                if end - start >= max(least, repeats * period) and smallest(ids, start, period):
                    new.add((start, end - start, period))
        for start, length, _ in new:
            np.maximum(covered[start : start + length], start + length, out=covered[start : start + length])
        found |= new
        block *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, repeats: int = REPEATS) -> DataFrame:
    """(id, runs, collapsed): every row's runs as structs of start, length and period, and its text without repetitions.

    Words are numbered from 0. The collapsed text is its kept words joined by one space. A null or empty text has no runs and
    collapses to the empty text; texts are read whole, however long. One row per input row, repeated rows and null ids
    too, in no order; columns other than the two are ignored, whatever their names; an empty table gives an empty one.
    """

    def row(_, words: list[bytes]) -> tuple:
        runs = runs_of(numbered(words), least, repeats)
        kept = kept_words(len(words), runs)
        return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(w for w, k in zip(words, kept, strict=True) if k).decode("utf-8", "replace")

    kind = df.schema[id_col].dataType.simpleString()
    return _by_row(df, id_col, text_col, f"id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string", row).withColumnRenamed("id", id_col)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query takes them: a tenth of the texts, by the id's crc32, repeat a part from some word on.

    A null id changes nothing.
    """
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row with its planted run.

    The four numbers are those of the longest run, null without any. Nulls, empty and long texts, ties, repeated rows,
    empty tables and other columns as for ``periodic_runs``; the digests are never null.
    """

    def row(doc_id: int | None, words: list[bytes]) -> tuple:
        words = planted(doc_id, words)
        runs = runs_of(numbered(words))
        start, length, period = longest(runs) or (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        text = b" ".join(words if not runs else [w for w, k in zip(words, kept_words(len(words), runs).tolist(), strict=True) if k])
        return len(runs), start, length, period, None if period is None else 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()

    return _by_row(df, id_col, text_col, "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", row).withColumnRenamed("id", id_col)


def _by_row(df: DataFrame, id_col: str, text_col: str, ddl: str, row: Callable[[int | None, list[bytes]], tuple]) -> DataFrame:
    def setup():
        def f(ids: list | None = None, texts: list | None = None):
            if ids:
                yield ids, *zip(*[row(i, words_of(t)) for i, t in zip(ids, texts, strict=True)], strict=True)

        return f

    return map_chunks(df, [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")], ddl, setup)
