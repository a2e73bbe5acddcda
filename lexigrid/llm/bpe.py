"""Byte-level BPE encoding and decoding over a contiguous rank array (operator 8).

A short word keeps its part boundaries and the ranks of adjacent pairs in two arrays; the smallest rank
is found by scanning, its boundary deleted, and the two neighbouring ranks refreshed. Longer words use
the same merge order from a heap, so that their time stays in proportion to n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import text_function

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words with more parts than this use the heap.
SHORT = 64
#: Encoded words kept in a worker; when full, the memory starts afresh.
CACHE = 100_000
NONE = 1 << 60


def byte_characters() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable character: itself, or one from 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file, given as its JSON text."""

    def __init__(self, vocabulary: str) -> None:
        data = json.loads(vocabulary)
        model, as_byte = data["model"], byte_characters()
        vocab = model["vocab"]
        self.token_bytes: dict[int, bytes] = {k: bytes(as_byte[c] for c in t) for t, k in vocab.items() if all(c in as_byte for c in t)}
        self.byte_ids = [0] * 256
        for c, b in as_byte.items():
            self.byte_ids[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.token_bytes |= {k: t.encode() for t, k in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find_words = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def merge_short(self, ids: list[int]) -> list[int]:
        pairs = self.pairs
        none = (NONE, 0)
        ranks = [pairs.get((ids[k], ids[k + 1]), none) for k in range(len(ids) - 1)]
        while ranks:
            best = min(ranks)
            if best[0] == NONE:
                break
            k = ranks.index(best)
            ids[k] = best[1]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = pairs.get((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = pairs.get((ids[k - 1], ids[k]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(p[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (p := pairs.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = pairs[a, b][1], -1
            right[k] = right[j]
            if right[k] < n:
                left[right[k]] = k
                if p := pairs.get((ids[k], ids[right[k]])):
                    heapq.heappush(heap, (p[0], k, ids[k], ids[right[k]]))
            if left[k] >= 0 and (p := pairs.get((ids[left[k]], ids[k]))):
                heapq.heappush(heap, (p[0], left[k], ids[left[k]], ids[k]))
        return [x for x in ids if x >= 0]

    def word_ids(self, raw: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in raw]
        return self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out, known = [], self.known
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                out.append(np.uint32(self.special[part]).astype("<u4").tobytes())
                continue
            for word in self.find_words(part):
                got = known.get(word)
                if got is None:
                    got = np.array(self.word_ids(word.encode()), "<u4").tobytes()
                    if len(word) <= SHORT:
                        if len(known) >= CACHE:
                            known.clear()
                        known[word] = got
                out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text or ""), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read on the driver; it has a fixed size and is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def codec_function(spark: SparkSession, path: str, ddl: str, row: Callable[[Codec, str], tuple]) -> Callable[[Column], Column]:
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))

    def setup():
        codec = _codec(vocabulary)

        def f(texts: list) -> list:
            return list(zip(*[row(codec, t or "") for t in texts], strict=True)) or [[] for _ in ddl.split(",")]

        return f

    return text_function(ddl, setup)


#: The codec of this Python worker, by the broadcast it was made from.
_CODECS: dict[int, Codec] = {}


def _codec(vocabulary) -> Codec:
    text = vocabulary.value
    if (key := hash(text)) not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(text)
    return _CODECS[key]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; a null or empty text has no ids."""
    f = codec_function(df.sparkSession, path, "ids array<int>", lambda c, t: (c.encode(t).tolist(),))
    return df.select(F.col(id_col), f(F.col(text_col)).alias("x")).select(id_col, "x.ids")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null or no ids give the empty text."""
    f = codec_function(df.sparkSession, path, "text string", lambda c, ids: (c.decode(np.array(ids or [], np.int64)),))
    return df.select(F.col(id_col), f(F.col(ids_col)).alias("x")).select(id_col, "x.text")


def digests(codec: Codec, text: str) -> tuple[int, str, str]:
    packed = codec.packed(text)
    back = codec.decode(np.frombuffer(packed, "<u4"))
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded in one pass, without moving ids.

    A null text counts as empty. One row per input row, repeated rows and null ids too, in no order; texts are read whole; an
    empty table gives an empty one; other columns are ignored, whatever their names.
    """
    f = codec_function(df.sparkSession, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
    return df.select(F.col(id_col), f(F.col(text_col)).alias("x")).select(id_col, "x.*")


def with_token_count(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All of ``df``'s rows and columns with the text replaced by its decoded ids, and n_tokens, ids_sha256 added.

    Columns of those names that are there already are replaced.
    """
    f = codec_function(df.sparkSession, path, "n_tokens long, ids_sha256 string, text string", _whole)
    new = {text_col: "text", "n_tokens": "n_tokens", "ids_sha256": "ids_sha256"}
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), f(F.col(text_col)).alias("x"))
    return own.select(*[F.col(f"x.{new[c]}" if c in new else f"row.`{c}`").alias(c) for c in df.columns + [c for c in new if c not in df.columns]])


def _whole(codec: Codec, text: str) -> tuple[int, str, str]:
    packed = codec.packed(text)
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), codec.decode(np.frombuffer(packed, "<u4"))
