"""Alignment of two tokenizers' tokens over the same bytes (operator 13).

Each tokenizer's token numbers are repeated over the token's bytes, which gives every byte an owner in A and one in B. Where
the pair of owners changes a new overlapping pair begins; where both owners change at once the text is cut into groups.

A text falls into units, which begin at a space or a line's end behind a visible character and at a full stop or comma
behind a letter or digit. No token of either vocabulary goes on over such a place (that is checked), so tokens, pairs and groups
of a text are those of its units, one after the other: a worker aligns each unit once, many in one piece of text, and
remembers it. A first pass counts pairs of ids over all texts, a second one looks the counts up. The most frequent pairs
are broadcast, up to a fixed number; those beyond it, if there are any, are joined by a shuffle, none of them hot.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigrid.llm.bpe import PATTERN, byte_characters, read_vocabulary
from lexigrid.llm.common import cut, map_chunks

#: Units and characters that a worker remembers; beyond either it starts afresh.
UNITS = 300_000
CHARACTERS = 16_000_000
#: Longer units, and those with other letters than Latin ones, are encoded one by one.
LONG = 500
WORD = "A-Za-z0-9À-ÖØ-öø-\u024f"
LATIN = "\u024f"
#: Pairs whose counts are broadcast at most: 16 MB.
FREQUENT = 1_000_000
#: A pair of ids is one number: A's times this, plus B's.
BASE = 1 << 32
SPACE = "▁"


class Aligner:
    """Both tokenizers and the units aligned so far."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        data, as_byte = json.loads(a_json), byte_characters()
        vocab = data["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) or self.b.is_unknown(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        plain = (data.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not data.get("normalizer")
        self.whole = not plain or any(re.search(rf"[^{SPACE}]{SPACE}|\n.|.\n|[{WORD}][.,]", p) for p in pieces)  # a vocabulary whose tokens go on over units
        merges = [m if isinstance(m, str) else " ".join(m) for m in data["model"]["merges"]]
        ranked = plain and all(vocab[m.replace(" ", "")] == 256 + k for k, m in enumerate(merges))  # ids in the order of merges
        ranks = {b: k for k, b in enumerate(self.bytes_a) if k < 256 + len(merges)}
        self.many = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranked and not self.whole else None
        self.space_b = self.b.encode("a ")[len(self.b.encode("a")) :]  # of a space at the end
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.characters = 0
        self.stats = np.zeros((0, 6), np.int64)  # tokens of A, of B, groups, links, best links, sum of counts
        self.valid = np.zeros(0, bool)
        self.groups: list[str] = []
        self.pairs: list[np.ndarray] = []  # of the units one after the other: all pairs, or those without a count
        self.kept: list[np.ndarray] = []  # how many of them each unit has

    #: Where units begin, and what shows that some separator stands at another place than these.
    BOUNDS = re.compile(rf"(?<=\S)(?=[ \n])|(?<=[{WORD}])(?=[.,])")
    LOOSE = re.compile(rf"(?:\A|\s)[ \n]|(?:\A|[^{WORD}])[.,]")

    def units(self, text: str) -> list[str]:
        """The units of a space and the text. Those that begin with one space are written without it."""
        if self.whole:
            return [text]
        if not self.LOOSE.search(text):
            return text.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")
        parts = self.BOUNDS.split(f" {text}")
        return [p[1:] if p[0] == " " and p[1:2] not in ("\n", ".", ",") else p for p in parts]

    def raw(self, unit: str) -> str:
        """A unit as it stands in the text."""
        return unit if unit[:1] in ("\n", ".", ",") or not self.whole and unit[:2] in (" \n", " .", " ,") else f" {unit}"

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B, and bytes of each unit, for Latin units that follow each other in one text; None if they can't."""
        text = "".join(units)
        raw = f" a{text}".encode()
        ids_a, ids_b = self.many(f" a{text}"), self.b.encode(f"a{text}", num_threads=1)
        if not b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            return None
        sizes = np.array([len(u) if u.isascii() else len(u.encode()) for u in units])
        return np.array(ids_a), np.array(ids_b), sizes

    def learn(self, keys: list[str], frequent: tuple | None) -> None:
        """Aligns units; ``frequent``: sorted pairs, their counts, the highest of each id of B."""
        raw = [self.raw(k) for k in keys]
        easy = [self.many is not None and k[0] in " \n" and k[-1:].strip() != "" and len(k) <= LONG and (k.isascii() or max(k) <= LATIN) for k in raw]
        first, rest = [k for k, e in enumerate(easy) if e], [k for k, e in enumerate(easy) if not e]
        if first and (got := self.encoded([raw[k] for k in first])):
            self.aligned([keys[k] for k in first], *got, " a", frequent)
        else:
            rest = sorted(first + rest)
        if rest:
            self.one_by_one([keys[k] for k in rest], [raw[k] for k in rest], frequent)

    def one_by_one(self, keys: list[str], raw: list[str], frequent: tuple | None) -> None:
        ids_a = [e.ids for e in self.a.encode_batch(raw, add_special_tokens=False)]
        lead = len(self.b.encode("a"))
        ids_b = [self.space_b if r == " " else self.b.encode(r[1:]) if r[0] == " " else self.b.encode(f"a{r}")[lead:] for r in raw]
        good = [b"".join(map(self.bytes_a.__getitem__, x)) == r.encode() == b"".join(map(self.bytes_b.__getitem__, y)) for x, y, r in zip(ids_a, ids_b, raw, strict=True)]
        flat = [np.array([i for ids, g in zip(x, good, strict=True) if g for i in ids], np.int64) for x in (ids_a, ids_b)]
        self.aligned([k for k, g in zip(keys, good, strict=True) if g], *flat, np.array([len(r.encode()) for r, g in zip(raw, good, strict=True) if g], np.int64), "", frequent)
        for k, g in zip(keys, good, strict=True):
            if not g:
                self.add([k], np.zeros((1, 6), np.int64), np.zeros(1, bool), [""], np.zeros(0, np.int64), np.zeros(1, np.int64))

    def aligned(self, keys: list[str], ids_a: np.ndarray, ids_b: np.ndarray, sizes: np.ndarray, lead: str, frequent: tuple | None) -> None:
        """Byte owners of units one behind the other, after ``lead``."""
        if not keys:
            return
        n, bounds = len(keys), len(lead) + np.cumsum(sizes)
        sides = []
        for ids, lengths in ((ids_a, self.len_a), (ids_b, self.len_b)):
            ends = np.cumsum(lengths[ids])
            skip = int(np.searchsorted(ends, len(lead), "right")) if lead else 0
            unit = np.searchsorted(bounds, ends[skip:])
            if not np.isin(bounds, ends).all():
                raise ValueError("a token goes on over the end of a unit")
            sides.append((ids[skip:], np.repeat(np.arange(len(ids) - skip), lengths[ids[skip:]]), unit))
        (flat_a, owner_a, unit_a), (flat_b, owner_b, unit_b) = sides
        next_a, next_b = np.diff(owner_a, prepend=-1) > 0, np.diff(owner_b, prepend=-1) > 0
        link, cuts = np.flatnonzero(next_a | next_b), next_a & next_b
        group, of_unit = np.cumsum(cuts) - 1, unit_a[owner_a[link]]
        pair = flat_a[owner_a[link]] * BASE + flat_b[owner_b[link]]
        links = np.bincount(of_unit, minlength=n)
        stats, kept, texts = np.zeros((n, 6), np.int64), links, [""] * n
        stats[:, :4] = np.stack([np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), np.bincount(unit_a[owner_a[cuts]], minlength=n), links], 1)
        if frequent is not None:
            count, best, found = looked_up(pair, *frequent)
            np.add.at(stats[:, 4], of_unit, best)
            np.add.at(stats[:, 5], of_unit, count)
            pair, kept = pair[~found], np.bincount(of_unit[~found], minlength=n)
            texts = written(flat_a, flat_b, group[next_a], group[next_b], np.flatnonzero(np.diff(unit_b, append=n)))
        self.add(keys, stats, np.ones(n, bool), texts, pair, kept)

    def add(self, keys: list[str], stats: np.ndarray, valid: np.ndarray, texts: list[str], pairs: np.ndarray, kept: np.ndarray) -> None:
        at = len(self.at)
        self.at.update(zip(keys, range(at, at + len(keys)), strict=True))
        self.characters += sum(map(len, keys))
        self.stats, self.valid = np.concatenate((self.stats, stats)), np.concatenate((self.valid, valid))
        self.groups += texts
        self.pairs.append(pairs)
        self.kept.append(kept)

    def pairs_of(self, numbers: np.ndarray) -> np.ndarray:
        """The pairs kept of some units."""
        if len(self.pairs) > 1:
            self.pairs, self.kept = [np.concatenate(self.pairs)], [np.concatenate(self.kept)]
        starts = np.concatenate(([0], np.cumsum(self.kept[0])))
        n = self.kept[0][numbers]
        return self.pairs[0][np.repeat(starts[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def new(self, texts: list[list[str]]) -> list[str]:
        """The units that are not known."""
        return list(set().union(*texts).difference(self.at))

    def full(self, new: list[str]) -> bool:
        """Whether new units don't fit beside those that are known."""
        return len(self.at) > 0 and (len(self.at) + len(new) > UNITS or self.characters > CHARACTERS)

    def numbers(self, texts: list[list[str]], new: list[str], frequent: tuple | None) -> list[np.ndarray]:
        """The numbers of each text's units, once the new ones are learned."""
        if new:
            self.learn(new, frequent)
        find = self.at.__getitem__
        return [np.fromiter(map(find, units), np.int64, len(units)) for units in texts]


def looked_up(pair: np.ndarray, known: np.ndarray, counts: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair's count, whether its id of B has no higher one, whether it is among the known ones."""
    if not len(known):
        return np.zeros(len(pair), np.int64), np.zeros(len(pair), bool), np.zeros(len(pair), bool)
    at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
    found = known[at] == pair
    count = np.where(found, counts[at], 0)
    return count, found & (count == highest[pair % BASE]), found


def written(flat_a: np.ndarray, flat_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last_b: np.ndarray) -> list[str]:
    """The groups of each unit, as `a1,a2|b1;a3|b2,b3`; ``last_b``: the places of the units' last tokens of B."""
    mark_a, mark_b = np.where(np.diff(group_a, append=-1) != 0, 1, 0), np.where(np.diff(group_b, append=-1) != 0, 2, 0)
    mark_b[last_b] = 3
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    ids, marks = np.concatenate((flat_a, flat_b))[order].tolist(), np.concatenate((mark_a, mark_b))[order].tolist()
    return "".join([f"{k}{',|;~'[m]}" for k, m in zip(ids, marks, strict=True)]).split("~")[:-1]


#: The aligner of this Python worker, by its files.
_ALIGNERS: dict[int, Aligner] = {}


def _aligner(files) -> Aligner:
    """A worker's aligner, without what an earlier task has learned: that may hold other counts."""
    if (key := hash(files.value)) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*files.value)
    _ALIGNERS[key].clear()
    return _ALIGNERS[key]


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums in whole numbers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, of, values)
    return out


def _parts(texts: list) -> list[list]:
    """Texts by and by, so that no batch of units is larger than a few long texts."""
    out, size = [[]], 0
    for t in texts:
        if size > 1_000_000:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t or "")
    return out


def pair_counts(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """(pair, n): how many links of all texts hold ids a and b, as the number a * 2**32 + b.

    Texts that are null, empty, or that either tokenizer does not give back byte for byte hold none.
    """
    files = _files(df, a_path, b_path)

    def setup():
        aligner, counts = _aligner(files), np.zeros(0, np.int64)

        def given():
            if aligner.pairs and len(links := np.concatenate(aligner.pairs)):
                keys, at = np.unique(links, return_inverse=True)
                n = _sums(at, np.repeat(counts, np.concatenate(aligner.kept)), len(keys))
                yield keys[n > 0], n[n > 0]

        def f(texts: list | None = None):
            nonlocal counts
            for part in _parts(texts or []):
                units = [aligner.units(t) for t in part if t]
                if aligner.full(new := aligner.new(units)):
                    yield from given()
                    aligner.clear()
                    new, counts = aligner.new(units), np.zeros(0, np.int64)
                numbers = aligner.numbers(units, new, None)
                good = [x for x in numbers if aligner.valid[x].all()]
                counts = np.concatenate((counts, np.zeros(len(aligner.at) - len(counts), np.int64)))
                if good:
                    counts += np.bincount(np.concatenate(good), minlength=len(counts))
            if texts is None:
                yield from given()

        return f

    return map_chunks(df, [F.col(f"`{text_col}`")], "pair long, n long", setup).groupBy("pair").agg(F.sum("n").alias("n"))


def _files(df: DataFrame, a_path: str, b_path: str):
    with open(b_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((read_vocabulary(a_path), f.read()))


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, written: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; with ``written`` also the groups.

    Tokens are those of a space and the text by the vocabulary of A, and of the text by B's model, which adds the space;
    strings of special tokens are plain text. n_best is the number of links whose pair no pair with the same id of B
    outnumbers in all texts, ties included; count_sum adds the pairs' counts over the links.

    Texts that are null or empty, or that the tokens of either side do not give back byte for byte, have zeros and an
    empty text for the digest. Texts are read whole, however long. One row per input row, repeated rows and null ids too, in no
    order; columns other than the two are ignored, whatever their names; an empty table gives an empty one.
    """
    spark, files = df.sparkSession, _files(df, a_path, b_path)
    counts = cut(pair_counts(df, a_path, b_path, text_col))
    total = counts.count()
    # as many rows as B has ids, and at most `frequent`
    tops = counts.groupBy((F.col("pair") % BASE).alias("b")).agg(F.max("n").alias("n")).toArrow()
    some = (counts if total <= frequent else counts.orderBy(F.desc("n"), "pair").limit(frequent)).toArrow()
    highest = np.zeros(1 + max(tops["b"].to_pylist(), default=0), np.int64)
    highest[tops["b"].to_numpy()] = tops["n"].to_numpy()
    order = np.argsort(some["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((some["pair"].to_numpy()[order], some["n"].to_numpy()[order], highest))

    def setup():
        aligner = _aligner(files)

        def row(doc_id, text, numbers) -> tuple:
            if not text or not aligner.valid[numbers].all():
                return (doc_id, 0, 0, 0, 0, 0, 0, "", "", [])
            groups = ";".join(map(aligner.groups.__getitem__, numbers.tolist()))
            rest = [] if total <= frequent else aligner.pairs_of(numbers)
            pairs, times = np.unique(rest, return_counts=True) if len(rest) else ([], [])
            return (doc_id, *aligner.stats[numbers].sum(0).tolist(), hashlib.sha256(groups.encode()).hexdigest(), groups if written else "", [{"pair": int(p), "times": int(t)} for p, t in zip(pairs, times, strict=True)])

        def f(ids: list | None = None, texts: list | None = None):
            done = 0
            for part in _parts(texts) if texts else ():
                units = [aligner.units(t) if t else [] for t in part]
                if aligner.full(new := aligner.new(units)):
                    aligner.clear()
                    new = aligner.new(units)
                numbers = aligner.numbers(units, new, sent.value)
                yield tuple(zip(*map(row, ids[done : done + len(part)], part, numbers), strict=True))
                done += len(part)

        return f

    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string, rest array<struct<pair: long, times: long>>"
    out = map_chunks(df, [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")], ddl, setup)
    if total > frequent:
        out = cut(out).withColumn("row", F.monotonically_increasing_id())  # a checkpoint's rows keep their places
        top = spark.createDataFrame(tops).withColumnsRenamed({"n": "top"})
        facts = counts.withColumn("b", F.col("pair") % BASE).join(F.broadcast(top), "b")
        more = out.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(facts, "pair")
        more = more.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("s"), F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("t"))
        out = out.join(more, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("t", F.lit(0))})
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * written)
