"""SimHash near-dedup with BK-trees (operator 2).

Distinct fingerprints are dealt to shards by three blocks of their bits: fingerprints that differ in at
most two bits agree in one block at least, so every link lies inside some shard. Each shard is a
BK-tree, children keyed by their Hamming distance to the parent, and a search follows only edges within
the radius. A shard with too many fingerprints is dealt again by three blocks of the bits that its key
leaves free, as often as needed; after four deals a shard can hold no more than 2**13 fingerprints.
A tree therefore meets the queries of its own shard only and is not broadcast to all of them, which
would cost fingerprints times shards. Only links that join two sets of a shard are given out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import connected_components, cut, join_by_key, text_function, without

#: Seed of the shingle hash; words in a shingle; bits that linked fingerprints may differ in.
SEED = 42
SHINGLE = 3
RADIUS = 2
#: A shard above this number of fingerprints is dealt again.
SHARD_MOST = 4096
DEALS = 4


def fingerprint_bytes(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; null and empty texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)), np.uint64, len(words) - last)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprint_function(width: int = SHINGLE) -> Callable[[Column], Column]:
    def setup():
        def f(texts: list) -> tuple:
            values = np.fromiter((fingerprint_bytes(t, width) for t in texts), np.uint64, len(texts))
            return (values.view(np.int64).tolist(),)

        return f

    return text_function("fp long", setup)


class BKTree:
    """Fingerprints by Hamming distance: the child at distance d of a node stands in its slot d."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_search(self, value: int, radius: int) -> list[int]:
        """Indices of stored values within ``radius``; the value itself is stored then (at a new index)."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return []
        found, stack = [], [0]
        values, children = self.values, self.children
        while stack:
            k = stack.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            if len(below := children[k]) > 2 * radius + 1:
                stack.extend(below[x] for x in range(max(d - radius, 0), d + radius + 1) if x in below)
            else:
                stack.extend(c for x, c in below.items() if d - radius <= x <= d + radius)
        k = 0
        while (nxt := children[k].get(d := (values[k] ^ value).bit_count())) is not None:
            k = nxt
        children[k][d] = len(values)
        values.append(value)
        children.append({})
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join all values of a shard which chains of links within ``radius`` connect."""
    if len(values) == 2:
        return [(values[0], values[1])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent, out = BKTree(), list(range(len(values))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, value in enumerate(values):
        for other in tree.add_and_search(value, radius):
            if (a := root(k)) != (b := root(other)):
                parent[max(a, b)] = min(a, b)
                out.append((values[other], value))
    return out


def fixed_masks(deals: int) -> list[list[int]]:
    """For each deal the bits that a key fixes: each of the last deal's, with a third of its free bits."""
    levels, last = [], [0]
    for _ in range(deals):
        now = []
        for mask in last:
            free = [b for b in range(64) if not mask >> b & 1]
            now += [mask | sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), RADIUS + 1)]
        levels.append(now)
        last = now
    return levels


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, shard_most: int = SHARD_MOST) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column ``fp`` which connect what is linked."""
    if radius != RADIUS:
        raise ValueError(f"the blocks are laid out for radius {RADIUS}")
    levels = fixed_masks(DEALS)
    rows = prints.select("fp", F.lit(0).alias("path"))
    parts = []
    for k, masks in enumerate(levels):
        table = F.array(*[F.lit(signed(m)) for m in masks])
        rows = rows.select("fp", F.explode(F.array(*[F.col("path") * 3 + j for j in range(3)])).alias("path"))
        rows = rows.select("fp", "path", F.xxhash64("path", F.col("fp").bitwiseAND(F.element_at(table, F.col("path") + 1))).alias("key"))
        if k == len(levels) - 1:
            parts.append(rows)
            break
        hot = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_most).select("key"))
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, "key", "left_anti"))
        rows = cut(rows.join(hot, "key", "left_semi").select("fp", "path"))
    edges = None
    for part in parts:
        found = part.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_search, "a long, b long")
        edges = found if edges is None else edges.union(found)
    return edges


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], bounds)), np.concatenate((bounds, [len(keys)]))
        out: list[tuple[int, int]] = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                out += shard_links(np.unique(fps[a:b]).view(np.uint64).tolist(), RADIUS)
        if out:
            both = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(keys) and keys[0] != keys[-1]:
            at = int(np.searchsorted(keys, keys[-1]))
            yield from of(keys[:at], fps[:at])
            keys, fps = keys[at:], fps[at:]
    if len(keys):
        yield from of(keys, fps)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that chains of links reach, itself included; null ids are passed over
    and get the component of the ids they are linked with, or null. Null and empty texts have fingerprint
    zero and are linked like any other. Repeated rows stay rows. Texts are read whole, however long; an empty table gives an
    empty one. Other columns are ignored, whatever their names.

    The trees are not broadcast: together they hold three places for each distinct fingerprint, which has no bound, so each
    meets the fingerprints of its own shard by a shuffle.
    """
    out = components(df, id_col, text_col, width)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def components(df: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """(id, mark, fp, component_id), one row per input row; mark is a hash of the text."""
    x = fingerprint_function(width)(F.col(text_col))
    docs = cut(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), x.alias("x")).select("id", "mark", F.col("x.fp").alias("fp")))
    prints = cut(docs.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    of = connected_components(links(prints.select("fp")))
    linked = cut(of.join(prints, of["node"] == prints["fp"]).select("fp", "label", "rep"))
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    linked = join_by_key(linked.select("fp", "label"), least, "label", "prints").select("fp", "component_id")
    known = prints.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component_id", "rep").alias("component_id"))
    return join_by_key(docs, cut(known), "fp", "rows")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """The rows of ``df``, all columns: of each component the row with the smallest id.

    Rows go by id and text, so of a repeated id only the texts go that are linked with a smaller id. Null ids
    stay if nothing with an id is linked with them; rows that repeat a kept row stay. Null and empty texts
    have fingerprint zero. An empty table stays empty; columns of any name are kept.
    """
    gone = components(df, id_col, text_col, width).where(~F.col("id").eqNullSafe(F.col("component_id")))
    return without(df, gone.select("id", "mark"), id_col, F.xxhash64(df[text_col]))
