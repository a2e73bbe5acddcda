"""Language-model scoring with a small causal self-attention model (operator 4).

The model reads subword ids of a public vocabulary. One attention head and a feed-forward layer, in
numpy, give the probability of the next token's class, first of its group and then of the class in it; a
class is one frequent token or a bin of rarer ones, and inside a bin tokens follow their counts in the
training documents. Word and subword counts come
from all training documents. Attention weights are trained by rounds of local Adam steps in as many tasks
as the corpus has windows for, whose weights are averaged; every place of every training document is
looked at in each round. A text is scored in overlapping windows with batched masked attention,
each token once.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import cut, fold, map_chunks

#: Fixed value: the split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Model: width, hidden width, window, tokens of context that a later window reads again.
WIDTH, HIDDEN, WINDOW, CONTEXT = 24, 48, 48, 12
#: Queries that meet the same keys at once.
BAND = 12
#: Classes: groups of neighbours in the order of frequency, and classes in a group.
GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
#: Classes that hold one token each; the others are bins of about equal weight.
SINGLES = 960
#: Weight of all classes' shares, in pairs, in the shares after one class.
PAIR_PRIOR = 20.0
#: Training: rounds, windows for a task, windows in a step, least steps of a task unless its windows came up EPOCHS times, rate.
ROUNDS, TASK_WINDOWS, STEP_WINDOWS, LEAST_STEPS, EPOCHS, RATE = 2, 32_768, 32, 800, 6, 0.02
#: Weight, in windows, of the normal prior of all parameters: steps draw them to zero, the less the more windows there are.
PRIOR_WINDOWS = 1000.0
#: One training window at a place chosen by hash for each document, and one more for every so many characters; the rest is cut up in order.
WINDOW_CHARS = 4_096
#: Windows that stand in a row of the rest at most.
STRETCH = 16
#: The most frequent words, at most so many, are broadcast with their counts; the others are joined.
MOST_KNOWN = 400_000
#: Words of chunks that are kept before they are counted together and given out.
FLUSH = 1_000_000
CACHE = 500_000
#: Texts of a task whose results are kept for copies of them.
COPIES = 4_000
#: Kinds of rows that one pass over the training texts gives: words, training windows, ends of texts, stretches of what no window holds.
WORD, PIECE, END, REST = 0, 1, 2, 3
#: White space that the split pattern knows and words may hold: such words are tokenised one at a time.
INNER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SMOOTH = 0.1


@dataclass
class Vocabulary:
    """The tokenizer's file, read on the driver: a fixed size, so it is broadcast with the model."""

    data: bytes
    encoding: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"data": self.data, "encoding": None}

    def tokenizer(self) -> tiktoken.Encoding:
        if self.encoding is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            self.encoding = tiktoken.Encoding("lm", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self.encoding

    @property
    def end(self) -> int:
        """The id of the end of a text, and of what stands before its first token."""
        return self.tokenizer().n_vocab


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Subwords:
    """Ids of texts, word by word: each word in lower case after one space. Known words are kept, up to CACHE."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        encoding = vocabulary.tokenizer()
        self.encode, self.end = lambda text: encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2"), vocabulary.end
        self.sizes = np.array([len(encoding.decode_single_token_bytes(k)) for k in range(vocabulary.end)])
        self.known: dict[bytes, bytes] = {}

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and where each word's end.

        Words are encoded in one text; the byte lengths of its ids show where each word ends. Words that may be
        split otherwise beside their neighbours are encoded alone.
        """
        packed = b" " + b" ".join(words)
        text = packed.decode("utf-8", "replace")
        if words and "\ufffd" not in text and not INNER_SPACE.search(text):
            ids = self.encode(text)
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            at = np.searchsorted(ends, wanted)
            if at[-1] < len(ends) and (ends[at] == wanted).all():
                return ids, at + 1
        if len(words) > 1:  # odd words are few: halves without one are encoded together
            half = len(words) // 2
            (a, x), (b, y) = self.ids_of(words[:half]), self.ids_of(words[half:])
            return np.concatenate((a, b)), np.concatenate((x, y + len(a)))
        ids = self.encode(" " + words[0].decode("utf-8", "replace")) if words else np.zeros(0, "<u2")
        return ids, np.full(len(words), len(ids))

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Of each of some distinct words its ids as unsigned 16-bit integers. Words are kept, up to CACHE."""
        got = list(map(self.known.get, words))
        if None in got:
            fresh = [w for w, x in zip(words, got, strict=True) if x is None]
            if len(self.known) + len(fresh) > CACHE:
                self.known.clear()
                fresh = words
            ids, ends = self.ids_of(fresh)
            raw, cuts = ids.tobytes(), (2 * ends).tolist()
            self.known.update((w, raw[a:b]) for w, a, b in zip(fresh, [0, *cuts], cuts, strict=False))
            got = list(map(self.known.__getitem__, words))
        return got

    def texts(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of texts, given as words."""
        return self.of_numbered(*numbered(texts), np.fromiter(map(len, texts), np.int64, len(texts)))

    def of_numbered(self, words: list[bytes], at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Ids of texts of some sizes, whose words stand one after another as places in ``words``."""
        packed = self.packed(words)
        ends = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed))) // 2
        return texts_of(np.frombuffer(b"".join(packed), "<u2"), ends, at, sizes)


def runs(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of runs with given ends in ``flat``, one after another, and where each ends."""
    n = np.diff(ends, prepend=0)[at]
    upto = np.cumsum(n)
    return flat[np.repeat(ends[at] - upto, n) + np.arange(upto[-1] if len(upto) else 0)], upto


def texts_of(flat: np.ndarray, ends: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Ids of texts of some sizes, whose words are the runs ``at``."""
    ids, upto = runs(flat, ends, at)
    cuts = np.concatenate(([0], upto))[np.cumsum(sizes)].tolist()
    return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Lexicon:
    """The most frequent words with the logs of their shares and their ids, for one look-up a word."""

    def __init__(self, words: list[bytes], logs: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        self.words, self.logs, self.flat, self.ends = words, logs, flat, ends
        self.place: dict[bytes, int] | None = None

    def __getstate__(self):
        return {**self.__dict__, "place": None}

    def find(self, words: list[bytes], subwords: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words the logs, not a number for those that are not here, and their ids as runs."""
        if self.place is None:
            self.place = dict(zip(self.words, range(len(self.words)), strict=True))
        get = self.place.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        here = at >= 0
        rare, rare_ends = subwords.ids_of([words[k] for k in np.flatnonzero(~here).tolist()])
        own, own_ends = runs(self.flat, self.ends, at[here])
        logs, ends, sizes = np.full(len(words), np.nan), np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        logs[here] = self.logs[at[here]]
        sizes[here], sizes[~here] = np.diff(own_ends, prepend=0), np.diff(rare_ends, prepend=0)
        order = np.concatenate((np.flatnonzero(here), np.flatnonzero(~here)))  # runs stand here first, then the rare ones
        both, both_ends = np.concatenate((own, rare)), np.cumsum(sizes[order])
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        flat, ends = runs(both, both_ends, back)
        return logs, flat, ends


def split_chunk(texts: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, for all their words in order the places among them, and the words of each text.

    The words are those of ``words_of``; Arrow splits and numbers them.
    """
    try:
        column = pa.array([t or "" for t in texts], pa.large_string())
    except UnicodeEncodeError:  # half of a surrogate pair
        words, at = numbered(split := [words_of(t) for t in texts])
        return pa.array(words, pa.large_binary()), at, np.fromiter(map(len, split), np.int64, len(split))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).cast(pa.large_binary()).dictionary_encode()
    sizes = np.bincount(owner.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes


def numbered(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of texts, and for all words in order their places among them: a small table, whatever the vocabulary."""
    place = dict.fromkeys(chain.from_iterable(texts))
    words = list(place)
    place = dict(zip(words, range(len(words)), strict=True))
    return words, np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), np.int64)


#: The tokeniser of this Python worker, by its vocabulary's hash.
_SUBWORDS: dict[int, Subwords] = {}


def subwords_of(vocabulary: Vocabulary) -> Subwords:
    if (key := hash(vocabulary.data)) not in _SUBWORDS:
        _SUBWORDS.clear()
        _SUBWORDS[key] = Subwords(vocabulary)
    return _SUBWORDS[key]


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of each row of z (overwritten) at one place."""
    if z.max(initial=0) > 60:
        z -= z.max(axis=-1, keepdims=True)
    picked = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return picked - np.log(np.maximum(z @ np.ones(z.shape[1], np.float32), np.float32(1e-37)))


def _excess(z: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
    """Puts in place of each row of z its softmax less one at its target, times its weight: the gradient of the negative log likelihood."""
    if z.max(initial=0) > 60:
        z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z *= (weight / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + at] -= weight


def _summed_over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of a's transpose and b, both with a row for each place of some windows, by parts: short sums stay in the cache."""
    return np.matmul(a.reshape(8, -1, a.shape[-1]).transpose(0, 2, 1), b.reshape(8, -1, b.shape[-1])).sum(axis=0)


@dataclass
class Pairs:
    """Natural log of each class's share after each class: of its group, (class before, group), and of it in the group.

    Pairs inside words are counted in all training documents, by the words' counts. After the last id of a word
    comes the first id of any word, or the end, by their shares. Each row is drawn to the shares of all classes.
    """

    top: np.ndarray
    inside: np.ndarray

    @classmethod
    def from_counts(cls, pairs: np.ndarray, lasts: np.ndarray, firsts: np.ndarray, shares: np.ndarray) -> Pairs:
        after = firsts / max(1.0, firsts.sum())
        count = pairs + lasts[:, None] * after
        count += PAIR_PRIOR * shares
        count /= count.sum(axis=1, keepdims=True)
        grouped = count.reshape(CLASSES, GROUPS, MEMBERS)
        of_group = grouped.sum(axis=2)
        return cls(np.log(of_group).astype(np.float32), np.log(grouped / of_group[:, :, None]).astype(np.float32))


class Attention:
    """Parameters in one flat float32 vector, viewed by name. Logits are added to those of the pairs of classes."""

    SHAPES = (("emb", (CLASSES, WIDTH)), ("pos", (WINDOW, WIDTH)), ("q", (WIDTH, WIDTH)), ("k", (WIDTH, WIDTH)), ("v", (WIDTH, WIDTH)), ("o", (WIDTH, WIDTH)), ("a", (WIDTH, HIDDEN)), ("b", (HIDDEN, WIDTH)), ("top", (WIDTH, GROUPS)), ("top_bias", (GROUPS,)), ("out", (GROUPS, WIDTH, MEMBERS)), ("bias", (GROUPS, MEMBERS)))
    SIZE = sum(math.prod(s) for _, s in SHAPES)
    SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def __init__(self, flat: np.ndarray, pairs: Pairs) -> None:
        self.flat, self.pairs, self.rooms, at = flat, pairs, {}, 0
        for name, shape in self.SHAPES:
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, pairs: Pairs, seed: int = 11) -> Attention:
        """Small random weights and no biases: at first the pairs alone speak."""
        r = np.random.default_rng(seed)
        net = cls(r.normal(0, 0.08, cls.SIZE).astype(np.float32), pairs)
        net.top[:] *= 0.2
        net.out[:] *= 0.2
        net.top_bias[:] = net.bias[:] = 0
        return net

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that holds what the last call left there: fresh ones of this size cost more than what is done with them."""
        got = self.rooms.get(name)
        if got is None or got.shape != shape:
            got = self.rooms[name] = np.empty(shape, np.float32)
        return got

    def last(self, x: np.ndarray, left: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Last activations at places skip to left of every window, in order.

        One layer needs queries at these places alone, and a query needs no later key: bands of BAND queries
        meet the keys up to the band's end. Queries times keys, and values times outputs, are products of the
        weights, taken once, the former for all classes and places too.
        """
        near = self.q @ self.k.T * np.float32(WIDTH**-0.5)
        e = self.emb.take(x, axis=0)
        e += self.pos
        asked = (self.emb @ near).take(x, axis=0)
        asked += self.pos @ near
        across = np.ascontiguousarray(e.transpose(0, 2, 1))
        mixed, total = np.ones(e.shape, np.float32), np.ones((*x.shape, 1), np.float32)
        for lo in range(0, WINDOW, BAND):
            hi, rows = min(lo + BAND, WINDOW), np.flatnonzero((left > lo) & (skip < lo + BAND))
            if not len(rows):
                continue
            rows = rows if 2 * len(rows) < len(e) else slice(None)  # to take rows apart costs a copy
            s = asked[rows, lo:hi] @ across[rows, :, :hi]
            if s.max() > 60:
                s -= np.where(self.SEEN[lo:hi, :hi] > 0, s, -1e9).max(axis=-1, keepdims=True)
                np.minimum(s, 0, out=s)
            np.exp(s, out=s)
            s[:, :, lo:] *= self.SEEN[lo:hi, lo:hi]
            mixed[rows, lo:hi] = s @ e[rows, :hi]
            total[rows, lo:hi] = s @ np.ones((hi, 1), np.float32)
        place = np.arange(WINDOW)
        scored = np.flatnonzero((place < left[:, None]) & (place >= skip[:, None]))
        h, m = e.reshape(-1, WIDTH).take(scored, axis=0), mixed.reshape(-1, WIDTH).take(scored, axis=0)
        moved = m @ (self.v @ self.o)
        moved /= total.reshape(-1, 1).take(scored, axis=0)
        h += moved
        u = h @ self.a
        h += np.maximum(u, 0, out=u) @ self.b
        return h

    def log_shares(self, rows: np.ndarray, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of the target class at each row of last activations: its group's, and its own in the group."""
        group, member = np.divmod(target, MEMBERS)
        z = rows @ self.top
        z += (self.pairs.top + self.top_bias).take(before, axis=0)
        logs = _log_softmax_at(z, group)
        order = np.argsort(group.astype(np.int16), kind="stable")
        rows, z, lo = rows.take(order, axis=0), np.empty((len(rows), MEMBERS), np.float32), 0
        for g, n in enumerate(np.bincount(group, minlength=GROUPS).tolist()):
            np.matmul(rows[lo : lo + n], self.out[g], out=z[lo : lo + n])
            lo += n
        group = group[order]
        z += self.bias.take(group, axis=0)
        z += self.pairs.inside.reshape(-1, MEMBERS).take(before[order] * GROUPS + group, axis=0)
        logs[order] += _log_softmax_at(z, member[order])
        return logs

    def gradient(self, x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Of the mean negative log likelihood of the targets y where ok; it holds until the next call.

        As in ``last``, queries times keys and values times outputs are products of the weights. Attention weights stay
        unscaled; what comes back is divided by their sums instead. Weights and what comes back to them stand above
        each other, so that one product gives the inputs' share of both. Biases are a last row of weights.
        """
        g, many, scale, room = self.slope(), x.size, np.float32(WIDTH**-0.5), self.room
        flat, ones, before = (lambda m: m.reshape(-1, m.shape[-1])), np.ones((WINDOW, 1), np.float32), x.ravel()
        near, moved = self.q @ self.k.T * scale, self.v @ self.o
        e, both, sides = room("e", *x.shape, WIDTH), room("both", len(x), 2 * WINDOW, WINDOW), room("sides", len(x), 2 * WINDOW, WIDTH)
        self.emb.take(x, axis=0, out=e, mode="clip")
        e += self.pos
        across = e.transpose(0, 2, 1)
        s, ds, dm, asked = both[:, :WINDOW], both[:, WINDOW:], sides[:, :WINDOW], sides[:, WINDOW:]
        np.matmul(e, near, out=asked)
        np.matmul(asked, across, out=s)
        if s.max() > 60:
            s -= np.where(self.SEEN > 0, s, -1e9).max(axis=-1, keepdims=True)
            np.minimum(s, 0, out=s)
        np.exp(s, out=s)
        s *= self.SEEN
        total = s @ ones
        mixed = np.matmul(s, e, out=room("mixed", *e.shape))
        mixed /= total
        h = np.matmul(flat(mixed), moved, out=room("h", many, WIDTH))
        h += flat(e)
        u = np.matmul(h, self.a, out=room("u", many, HIDDEN))
        np.maximum(u, 0, out=u)
        rows = room("rows", many, WIDTH + 1)
        np.add(h, np.matmul(u, self.b, out=room("d", many, WIDTH)), out=rows[:, :-1])
        rows[:, -1] = 1

        group, member = np.divmod(y.ravel(), MEMBERS)
        order = np.argsort(group.astype(np.int16), kind="stable")
        own, grouped, back = rows.take(order, axis=0, out=room("own", *rows.shape), mode="clip"), group[order], room("back", many, WIDTH)
        top, out = np.concatenate((self.top, self.top_bias[None])), np.concatenate((self.out, self.bias[:, None]), axis=1)
        z, inner, shift = room("z", many, MEMBERS), room("inner", many, MEMBERS), room("shift", many, MEMBERS)
        bounds = np.searchsorted(grouped, np.arange(GROUPS + 1)).tolist()
        parts = [(n, slice(lo, hi)) for n, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if hi > lo]
        weight = ok.ravel() * np.float32(1 / max(1, np.count_nonzero(ok)))
        np.dot(rows, top, out=z)
        z += self.pairs.top.take(before, axis=0, out=shift, mode="clip")
        _excess(z, group, weight)
        for n, part in parts:
            np.dot(own[part], out[n], out=inner[part])
        inner += self.pairs.inside.reshape(-1, MEMBERS).take(before[order] * GROUPS + grouped, axis=0, out=shift, mode="clip")
        _excess(inner, member[order], weight[order])

        slope = _summed_over(rows, z)
        g.top[:], g.top_bias[:] = slope[:-1], slope[-1]
        d, more, slope, turned = np.matmul(z, self.top.T, out=room("d", many, WIDTH)), room("more", many, WIDTH), room("slopes", *out.shape), self.out.transpose(0, 2, 1)
        slope[:] = 0
        for n, part in parts:
            z = inner[part]
            np.dot(own[part].T, z, out=slope[n])
            np.dot(z, turned[n], out=back[part])
        g.out[:], g.bias[:] = slope[:, :-1], slope[:, -1]
        place = np.empty(many, np.int64)
        place[order] = np.arange(many)
        d += back.take(place, axis=0, out=more, mode="clip")
        g.b[:] = _summed_over(u, d)
        du = np.matmul(d, self.b.T, out=room("du", many, HIDDEN))
        du *= u > 0
        g.a[:] = _summed_over(h, du)
        d += np.matmul(du, self.a.T, out=more)
        slope = _summed_over(mixed, d)
        np.matmul(slope, self.o.T, out=g.v)
        np.matmul(self.v.T, slope, out=g.o)
        np.divide(np.matmul(d, moved.T, out=more).reshape(e.shape), total, out=dm)
        np.matmul(dm, across, out=ds)
        mixed *= dm
        ds -= (flat(mixed) @ np.ones(WIDTH, np.float32)).reshape(total.shape)
        ds *= s
        da = np.matmul(ds, e, out=mixed)
        slope = _summed_over(e, da)
        slope *= scale
        np.matmul(slope, self.k, out=g.q)
        np.matmul(slope.T, self.q, out=g.k)
        d += np.matmul(flat(da), near.T, out=more)
        d += flat(np.matmul(both.transpose(0, 2, 1), sides, out=more.reshape(e.shape)))
        order = np.argsort(before.astype(np.int16), kind="stable")
        seen = before[order]
        first = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1])))
        g.emb[:] = 0
        g.emb[seen[first]] = np.add.reduceat(d.take(order, axis=0, out=more, mode="clip"), first, axis=0)
        d.reshape(e.shape).sum(axis=0, out=g.pos)
        return g.flat

    def slope(self) -> Attention:
        """Room for a gradient."""
        if "slope" not in self.rooms:
            self.rooms["slope"] = Attention(np.empty(self.SIZE, np.float32), self.pairs)
        return self.rooms["slope"]

    def train(self, windows: np.ndarray, ok: np.ndarray, steps: int, rate: float, seed: int) -> Attention:
        """Adam steps over windows of WINDOW + 1 classes; ok marks the targets that exist. Means of gradients are kept ten times, those of squares a hundred times as large."""
        r = np.random.default_rng(seed)
        net, m, v, step = Attention(self.flat.copy(), self.pairs), np.zeros(self.SIZE, np.float32), np.zeros(self.SIZE, np.float32), np.empty(self.SIZE, np.float32)
        order, prior = np.zeros(0, np.int64), PRIOR_WINDOWS / max(PRIOR_WINDOWS, len(windows))
        for k in range(steps):
            while len(order) < STEP_WINDOWS:  # pass after pass, each over all windows
                order = np.concatenate((order, r.permutation(len(windows))))
            pick, order = order[:STEP_WINDOWS], order[STEP_WINDOWS:]
            g = net.gradient(windows[pick, :-1], windows[pick, 1:], ok[pick])
            size, fill, wide = rate * (1 - k / steps * 0.9), 1 - 0.9 ** (k + 1), math.sqrt(1 - 0.99 ** (k + 1))
            m *= np.float32(0.9)
            m += g
            v *= np.float32(0.99)
            v += np.multiply(g, g, out=step)
            np.sqrt(v, out=step)
            step += np.float32(1e-7 * wide)
            np.divide(m, step, out=step)
            step *= np.float32(size * wide / fill)
            net.flat *= np.float32(1 - size * prior)
            net.flat -= step
        return net


@dataclass
class Classes:
    """Class of each token, and the natural log of its share inside the class."""

    of: np.ndarray
    inside: np.ndarray
    shares: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Classes:
        weight = counts + SMOOTH
        order = np.lexsort((np.arange(len(weight)), -weight))
        of = np.empty(len(weight), np.int32)
        singles = min(SINGLES, len(weight))
        of[order[:singles]] = np.arange(singles)
        rest = order[singles:]
        run = np.cumsum(weight[rest])
        of[rest] = singles + np.minimum((run - weight[rest] / 2) / run[-1] * (CLASSES - singles), CLASSES - singles - 1).astype(np.int32)
        total = np.bincount(of, weights=weight, minlength=CLASSES)
        shares = np.maximum(total, 1e-9) / total.sum()
        return cls(of, np.log(weight / total[of]).astype(np.float64), shares.astype(np.float32))


@dataclass
class LanguageModel:
    vocabulary: Vocabulary
    classes: Classes
    pairs: Pairs
    flat: np.ndarray

    def score(self, texts: list, batch: int = 256) -> list[float]:
        """log10 probability of each text, end included: overlapping windows, each token once."""
        return self.score_words([words_of(t) for t in texts], batch)

    def score_words(self, texts: list[list[bytes]], batch: int = 256) -> list[float]:
        return self.score_ids(subwords_of(self.vocabulary).texts(texts), batch)

    def score_ids(self, texts: list[np.ndarray], batch: int = 256) -> list[float]:
        """The same for texts as subword ids, without ends. Windows follow each other, so that what they score is all targets in order."""
        if not texts:
            return []
        net, fresh, end = Attention(self.flat, self.pairs), WINDOW - CONTEXT, np.array([self.vocabulary.end], "<u2")
        parts = [x for ids in texts for x in (end, ids, end)]
        sizes = np.array([len(x) + 1 for x in parts[1::3]])  # targets: the tokens and the end
        stream = np.concatenate((*parts, np.zeros(WINDOW, "<u2")))
        offset = np.cumsum(sizes + 1) - sizes - 1
        n_windows = np.maximum(1, -(-(sizes - CONTEXT) // fresh))
        text = np.repeat(np.arange(len(sizes)), n_windows)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * fresh
        start = (offset[text] + first).astype(np.int32)
        left = np.minimum(sizes[text] - first, WINDOW).astype(np.int16)
        skip = np.where(first > 0, CONTEXT, 0).astype(np.int16)
        wide = np.arange(WINDOW, dtype=np.int32)
        classes = self.classes.of[stream]
        ahead = np.ones(len(stream) - WINDOW, bool)
        ahead[offset] = False
        ahead = np.flatnonzero(ahead)  # places of all targets
        target, before, done = classes[ahead], classes[ahead - 1], 0
        logs = self.classes.inside[stream[ahead]]
        for s in range(0, len(text), batch):
            rows = net.last(classes[start[s : s + batch, None] + wide], left[s : s + batch], skip[s : s + batch])
            logs[done : done + len(rows)] += net.log_shares(rows, before[done : done + len(rows)], target[done : done + len(rows)])
            done += len(rows)
        return (np.add.reduceat(logs, np.cumsum(sizes) - sizes) / math.log(10)).tolist()


def gather(train: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """(kind, word, c) from one pass over all training texts: words and their counts, the number of texts, training windows, the rest.

    A window is an 8-byte key and at most WINDOW + 1 ids from a hash-chosen place, a multiple of WINDOW, so that what stands
    before it is whole windows too; each text gives one, and one more from each further WINDOW_CHARS characters. What the windows of a text leave comes as stretches of up to
    STRETCH windows, an 8-byte key and the ids, so that each id but the first is a target of some row.
    """

    def setup():
        kept: list[tuple[pa.Array, np.ndarray]] = []  # words of chunks and their counts
        subwords = subwords_of(vocabulary.value)
        end = np.array([subwords.end], "<u2").tobytes()

        def give():
            if kept:
                words = pa.chunked_array([w for w, _ in kept], pa.large_binary())
                once = pa.table({"word": words, "c": np.concatenate([n for _, n in kept])}).group_by("word").aggregate([("c", "sum")]).combine_chunks()
                kept.clear()
                for part in once.to_batches(65_536):
                    yield pa.array(np.full(part.num_rows, WORD, np.int32)), part.column("word"), part.column("c_sum")

        def f(ids: list | None = None, texts: list | None = None):
            if ids is None:
                yield from give()
                return
            words, at, sizes = split_chunk(texts)
            kept.append((words, np.bincount(at, minlength=len(words)).astype(np.int64)))
            packed = subwords.packed(words.to_pylist())
            flat = np.frombuffer(b"".join(packed), "<u2")
            upto = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed))) // 2
            own = texts_of(flat, upto, at, sizes)
            long, ends = np.concatenate(([0], np.cumsum(np.diff(upto, prepend=0)[at]))), np.cumsum(sizes)
            windows, rest = [], []
            for i, text, begin, size, ids_of in zip(ids, texts, (ends - sizes).tolist(), sizes.tolist(), own, strict=True):
                pieces, places = 1 + len(text or "") // WINDOW_CHARS, []
                raw = end + ids_of.tobytes() + end
                for k in range(pieces):
                    key = xxhash.xxh64_intdigest(f"{i} {k}", 5) >> 2
                    lo, hi = size * k // pieces, size * (k + 1) // pieces
                    start = 0 if not k and not key % 3 else lo + (key >> 8) % max(1, hi - lo)
                    place = (int(long[begin + start] - long[begin]) + 1) // WINDOW * WINDOW if start else 0
                    places.append(place)
                    windows.append(key.to_bytes(8, "big") + raw[2 * place : 2 * (place + WINDOW + 1)])
                done = 0  # the last id that was a target, or stands before the first
                for place in (*sorted(places), len(raw) // 2 - 1):
                    for x in range(done, place, STRETCH * WINDOW):
                        key = xxhash.xxh64_intdigest(f"{i} rest {x}", 5) >> 2
                        rest.append(key.to_bytes(8, "big") + raw[2 * x : 2 * (min(place, x + STRETCH * WINDOW) + 1)])
                    done = max(done, place + WINDOW)
            yield [PIECE] * len(windows), windows, [1] * len(windows)
            yield [REST] * len(rest), rest, [1] * len(rest)
            yield [END], [b""], [len(ids)]
            if sum(len(w) for w, _ in kept) > FLUSH:
                yield from give()

        return f

    found = map_chunks(train, [F.col(id_col).cast("string"), F.col(text_col)], "kind int, word binary, c long", setup)
    return cut(found.groupBy("kind", "word").agg(F.sum("c").alias("c")))


#: Stands for the place before a word's first id, and after its last.
EDGE = 0xFFFF


def id_pairs(words: DataFrame, vocabulary) -> DataFrame:
    """(a, b, n): how often id b follows id a inside a word of the training texts, by their words' counts; EDGE stands before and behind."""

    def setup():
        subwords = subwords_of(vocabulary.value)
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def give():
            codes, back = np.unique(np.concatenate([c for c, _ in kept]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([n for _, n in kept])).astype(np.int64)  # whole numbers far below 2**53
            kept[:] = [(codes, counts)]

        def f(words: list | None = None, c: list | None = None):
            if words is None:
                if kept:
                    give()
                    codes, counts = kept.pop()
                    for at in range(0, len(codes), 65_536):
                        part = codes[at : at + 65_536]
                        yield pa.array((part >> 16).astype(np.int32)), pa.array((part & EDGE).astype(np.int32)), pa.array(counts[at : at + 65_536])
                return
            ids, ends = subwords.ids_of(words)
            sizes = np.diff(ends, prepend=0)
            steps = np.full(len(ids) + len(words), EDGE, np.int64)  # each word's ids and an edge behind
            steps[np.arange(len(ids)) + np.repeat(np.arange(len(words)), sizes)] = ids
            before = np.concatenate(([EDGE], steps[:-1]))
            kept.append((before << 16 | steps, np.repeat(np.array(c, np.int64), sizes + 1)))
            if sum(len(x) for x, _ in kept) > FLUSH:
                give()

        return f

    found = map_chunks(words, ["word", "c"], "a int, b int, n long", setup, 16384)
    return cut(found.groupBy("a", "b").agg(F.sum("n").alias("n")))


def subword_counts(pairs: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in the training texts' words."""
    out = np.zeros(size)
    for r in pairs.where(F.col("b") != EDGE).groupBy("b").agg(F.sum("n").alias("n")).toLocalIterator():  # one row for each id of the vocabulary
        out[r["b"]] = r["n"]
    return out


def class_pairs(pairs: DataFrame, classes: Classes, ends: int) -> Pairs:
    """The pairs of classes that follow each other in the training texts."""
    spark = pairs.sparkSession
    of = F.broadcast(spark.createDataFrame([(EDGE, CLASSES), *enumerate(classes.of.tolist())], "id int, class int"))  # a row for each id of the vocabulary
    rows = pairs.join(of.withColumnsRenamed({"id": "a", "class": "x"}), "a").join(of.withColumnsRenamed({"id": "b", "class": "y"}), "b")
    count = np.zeros((CLASSES + 1, CLASSES + 1))
    for r in rows.groupBy("x", "y").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most as many rows as pairs of classes
        count[r.column("x").to_numpy(), r.column("y").to_numpy()] += r.column("n").to_numpy()
    firsts, lasts, end = count[CLASSES, :CLASSES], count[:CLASSES, CLASSES], classes.of[-1]
    firsts[end] += ends
    lasts[end] += ends
    return Pairs.from_counts(count[:CLASSES, :CLASSES], lasts, firsts, classes.shares)


def most_frequent(words: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words and their counts, at most ``most``: words of one count, by eighths of a power of two, stay together."""
    step = F.floor(F.log2("c") * 8)
    left, least = most, None
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).toLocalIterator():  # at most 512 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return {} if least is None else {bytes(r["word"]): r["c"] for r in words.where(step >= least).select("word", "c").toLocalIterator()}


def windows_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WINDOW + 1 ids, each target in one of them, from rows of ids of any length; and which targets exist."""
    sizes = [max(1, -(-(len(raw) // 2 - 1) // WINDOW)) for raw in rows]
    ids, ok, at = np.zeros((sum(sizes), WINDOW + 1), np.int64), np.zeros((sum(sizes), WINDOW), bool), 0
    for raw, n in zip(rows, sizes, strict=True):
        got = np.zeros(n * WINDOW + 1, np.int64)
        got[: len(raw) // 2] = np.frombuffer(raw, "<u2")
        ids[at : at + n] = np.lib.stride_tricks.sliding_window_view(got, WINDOW + 1)[::WINDOW]
        ok[at : at + n] = (np.arange(n * WINDOW) < len(raw) // 2 - 1).reshape(n, WINDOW)
        at += n
    return ids, ok


def train_attention(windows: DataFrame, classes: Classes, pairs: Pairs, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after rounds of training on all windows of rows (key, ids), in slots of about TASK_WINDOWS each, and averaging; no task holds more than a few slots' worth.

    Rows of more than WINDOW + 1 ids are cut up, each target being in one window. Which slot a row falls in, its place there and the slot's seed come from the windows alone (``ids``, and ``key`` to
    tell copies apart), and the average is summed up in whole numbers, so the weights are the same however the rows are
    dealt over the cluster.
    """
    spark = windows.sparkSession
    total = windows.agg(F.sum(F.greatest(F.lit(1), F.ceil((F.length("ids") / 2 - 1) / WINDOW)))).first()[0]
    flat = Attention.start(pairs).flat
    if not total:
        return flat
    slots = max(1, -(-total // TASK_WINDOWS))
    for n in range(rounds):
        shared = spark.sparkContext.broadcast((flat, classes.of, pairs))

        def run(batches, shared=shared, n=n):
            start, of, pairs = shared.value

            def trained(slot: int, rows: list[bytes]) -> pa.RecordBatch:
                ids, ok = windows_of(rows)
                once = -(-len(ids) // STEP_WINDOWS)
                steps = max(once, min(LEAST_STEPS, EPOCHS * once))
                net = Attention(start, pairs).train(of[ids], ok, steps, RATE / (1 + n), rounds * slot + n)
                return pa.RecordBatch.from_arrays([pa.array([net.flat.tobytes()], pa.binary()), pa.array([len(ids)], pa.int64())], names=["flat", "n"])

            at, rows = None, []
            for b in batches:
                for slot, raw in zip(b.column("slot").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    if slot != at and rows:
                        yield trained(at, rows)
                        rows = []
                    at = slot
                    rows.append(raw)
            if rows:
                yield trained(at, rows)

        place = F.shiftrightunsigned(F.xxhash64("ids", "key", F.lit(n)), 1)
        dealt = windows.select("ids", "key", place.alias("place"), (place % slots).cast("int").alias("slot"))
        dealt = dealt.repartition(slots, "slot").sortWithinPartitions("slot", "place", "ids", "key").select("slot", "ids")
        found = dealt.mapInArrow(run, "flat binary, n long")
        few = max(1, math.isqrt(slots))
        mean = found.repartition(few).mapInArrow(_sum, "flat binary, n long").coalesce(1).mapInArrow(_mean, "flat binary, n long").first()
        flat = np.frombuffer(mean["flat"], np.float32).copy()
    return flat


#: Weights are averaged in steps of one by this.
PRECISION = 1 << 20


def _summed(batches, first: bool) -> tuple[np.ndarray, int]:
    total, n = np.zeros(Attention.SIZE, np.int64), 0
    for b in batches:
        for raw, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total += k * np.rint(np.frombuffer(raw, np.float32).astype(np.float64) * PRECISION).astype(np.int64) if first else np.frombuffer(raw, np.int64)
            n += k
    return total, n


def _sum(batches):
    total, n = _summed(batches, True)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["flat", "n"])


def _mean(batches):
    total, n = _summed(batches, False)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([(total / (n * PRECISION)).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["flat", "n"])


def score_corpus(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training rows are those whose crc32 of the id, modulo ``modulus``, is not 0. Scores are log10
    probabilities of the whole text and its end; base_score is that of single words with counts from all
    training rows. Rows must come in a fixed order within their partitions, as they do from files or a checkpoint, since a lost
    task is done again beside others that are kept. Texts are read whole, however long; an empty table gives an empty one. Null texts count as empty: one token, the end. Null ids count as an empty id for the
    fold. Repeated rows each count and each get a row; other columns are ignored.
    """
    spark = df.sparkSession
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(Vocabulary(f.read()))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = docs.where(fold("id", modulus) != 0)
    gathered = gather(train, "id", "text", vocabulary)
    counts = gathered.where(F.col("kind") == WORD).select("word", "c")
    ends = gathered.where(F.col("kind") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    neighbours = id_pairs(counts, vocabulary)
    sub = subword_counts(neighbours, vocabulary.value.end + 1)
    sub[-1] = ends
    classes = Classes.from_counts(sub)
    # copies of a window are told apart by their number, written out by COPIES of them at a time
    pieces = gathered.where(F.col("kind").isin(PIECE, REST)).select(F.col("word").alias("ids"), "c", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(COPIES))).alias("k"))
    pieces = pieces.select("ids", F.explode(F.sequence("k", F.least(F.col("c"), F.col("k") + COPIES) - 1)).alias("k"))
    windows = pieces.select(F.expr("substring(ids, 9)").alias("ids"), F.xxhash64("ids", "k").alias("key"))
    pairs = class_pairs(neighbours, classes, ends)
    flat = train_attention(windows, classes, pairs)
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = words + ends, kinds + int(ends > 0)
    low = math.log10(n + SMOOTH * (v + 1))
    known = most_frequent(counts, MOST_KNOWN)
    lexicon = Lexicon(list(known), np.log10(np.fromiter(known.values(), float, len(known)) + SMOOTH) - low, *subwords_of(vocabulary.value).ids_of(list(known)))
    shared = spark.sparkContext.broadcast((LanguageModel(vocabulary.value, classes, pairs, flat), lexicon, math.log10(ends + SMOOTH) - low, int(ends > 0)))

    def setup():
        model, lexicon, end_log, end_known = shared.value
        subwords = subwords_of(model.vocabulary)
        first = TaskContext.get().partitionId() << 33
        seen, done = 0, {}

        def of_texts(texts: list) -> list[tuple]:
            """Of each text: words and end, known ones, base log without rare words, rare words, their times, score."""
            column, at, sizes = split_chunk(texts)
            words = column.to_pylist()
            logs, flat_ids, ends = lexicon.find(words, subwords)
            text, log = np.repeat(np.arange(len(texts)), sizes), logs[at]
            common = ~np.isnan(log)
            base = np.bincount(text[common], log[common], len(texts)) + end_log
            n_known = np.bincount(text[common], minlength=len(texts)) + end_known
            pairs, times = np.unique(text[~common] * max(1, len(words)) + at[~common], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(words))).tolist()
            rare, times = [words[k] for k in (pairs % max(1, len(words))).tolist()], times.tolist()
            scores = model.score_ids(texts_of(flat_ids, ends, at, sizes))
            return [(n + 1, k, b, rare[lo:hi], times[lo:hi], s) for n, k, b, lo, hi, s in zip(sizes.tolist(), n_known.tolist(), base.tolist(), cuts, cuts[1:], scores, strict=False)]

        def f(ids: list | None = None, texts: list | None = None):
            nonlocal seen
            if ids is None:
                return
            digests = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            fresh = {d: t for d, t in zip(digests, texts, strict=True) if d not in done}  # copies are scored once
            if len(done) + len(fresh) > COPIES:
                done.clear()
                fresh = dict(zip(digests, texts, strict=True))
            done.update(zip(fresh, of_texts(list(fresh.values())), strict=True))
            main, rare = [done[d] for d in digests], ([], [], [])
            uids = list(range(first + seen, first + seen + len(ids)))
            seen += len(ids)
            for uid, x in zip(uids, main, strict=True):
                rare[0].extend([uid] * len(x[3]))
                rare[1].extend(x[3])
                rare[2].extend(x[4])
            none = [None] * len(rare[0])
            # a document's own row has a word that no text can hold, so that the join deals it by itself
            yield uids, [b" %d" % u for u in uids], [0] * len(ids), ids, *map(list, zip(*(x[:3] for x in main), strict=True)), [x[5] for x in main]
            yield rare[0], rare[1], rare[2], none, none, none, none, none

        return f

    id_type = df.schema[id_col].dataType.simpleString()
    rows = map_chunks(docs, ["id", "text"], f"uid long, word binary, n int, id {id_type}, n_tokens long, n_known long, base double, score double", setup)
    joined = rows.join(counts.hint("shuffle_hash"), "word", "left")
    rare_log = F.when(F.col("n") > 0, F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + SMOOTH) - low)).otherwise(0.0)
    out = joined.groupBy("uid").agg(
        F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.max("base") + F.sum(rare_log)).alias("base_score"), F.max("score").alias("score"),
    )
    return out.select(F.col("id").alias(id_col), (fold("id", modulus) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
