"""Near-dedup of the pipeline: groups of texts that five-word shingles link at Jaccard similarity 0.8 or more.

Each set has a 64-bit SimHash, and the BK-trees of operator 2 link SimHashes of at most two differing bits; what they link
is compared exactly. A SimHash spreads most pairs of that similarity over about 4 to 18 bits, where it can't tell them from
strangers, so prefixes give the pairs that it leaves apart, and lose none: shingles have one order over all texts, rarer
ones first; two sets that are similar enough share a shingle among the first n - ceil(0.8 n) + 1 of each.
The order is by the counts in a bounded sample, then by hash; any order is right, the sample only keeps lists short.

Groups are wanted, not pairs, so most pairs of a group need not be looked at. First each set is compared with the few
most central sets of each of its shingles' lists, those whose shingles most others share: copies of one text are linked by
them. Then all pairs that share a listed shingle but are not yet in one group are compared, so that no link between
groups is lost. Sketches of 256 bits, which differ in no more places than the sets do, keep away pairs that have only a
passage in common. Lists are joined, never gathered: a shingle that very many sets hold is split like any skewed key.

What would be shuffled whole is taken a slice at a time, by a hash of the shingle, the set or the pair, and each slice's
files go before the next: lists don't depend on each other. Texts are never shuffled to look their shingles up.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import add

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm import simhash
from lexigrid.llm.common import BROADCAST_ROWS, HEAVY, connected_components, cut, hash_order, join_by_key, map_chunks, text_function, without
from lexigrid.session import delete, keep, scratch

SHINGLE = 5
SIMILARITY = 0.8
#: Documents whose shingles are counted (expected number; fixed by the id), least count that is kept, most that are kept.
SAMPLE_ROWS = 20_000
LEAST_COUNT = 3
MOST_COUNTED = 200_000
FLUSH = 500_000
#: Longs in a set's sketch.
SKETCH = 4
#: Sets of each list that all others of it are compared with first.
CENTRAL = 4
#: Rows of lists, and numbers of sets that are compared, which are shuffled at once; slices at most, above which these grow.
SLICE_ROWS = 8_000_000
SLICE_INTS = 64_000_000
MOST_SLICES = 16


def slices(count: int, most: int) -> int:
    return max(1, min(MOST_SLICES, -(-count // most)))


def slice_of(df: DataFrame, k: int, of: int, *key: str) -> DataFrame:
    """The k-th of so many slices of the rows, by a hash that no shuffle deals by."""
    return df if of == 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(of)) == k)


def shingles_of(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; shorter texts have one of all their words, empty ones one of none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[a:b]) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1).view(np.int64))


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Which of 64 * SKETCH classes hold an odd number of a set's shingles: two sets differ in at least as many as their sketches do."""
    odd = np.bincount((shingles >> 20) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def simhash_of(shingles: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the set's hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        counts += np.unpackbits(shingles[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def common_shingles(df: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of the sample hold, in order, and their counts."""

    def setup():
        kept: Counter = Counter()

        def f(texts: list | None = None):
            for t in texts or ():
                kept.update(shingles_of(t).tolist())
            if kept and (texts is None or len(kept) > FLUSH):
                yield list(kept), list(kept.values())
                kept.clear()

        return f

    total = df.count()
    sample = df.where(hash_order(id_col) * total < SAMPLE_ROWS)
    counted = map_chunks(sample, [F.col(text_col)], "s long, n long", setup).groupBy("s").agg(F.sum("n").alias("n"))
    rows = cut(counted.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "s").limit(MOST_COUNTED)).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def prefix_of(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the order of count, then hash, of which similar sets share one."""
    n = len(shingles)
    take = n - math.ceil(similarity * n - 1e-9) + 1
    if not len(common):
        return shingles[:take]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    seen = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, seen))[:take]]


def listed(sets: DataFrame, prints: DataFrame, common: tuple[np.ndarray, np.ndarray], path: str) -> DataFrame:
    """(s, fp, n, pos, w) and the sketch: the places of each set's prefix shingles, of those that c > 1 sets hold; w is the
    mean c of the set's. Written under ``path``.

    Prefixes are of 32-bit hashes: what these make equal is told apart when sets are compared. Shingles that over 1/HEAVY
    of the sample holds are not counted anew but by the sample, so that no task gathers their holders; c only
    weighs. A set stands once in ``sets`` and so in each list. Lists are written by sets, whose rows follow each other, as
    compressed columns: a checkpoint would write each row's sketch again. Counts are written first, without sketches.
    """
    shingles, counts = common
    heavy = [int(x) for x in np.unique(shingles[counts * HEAVY > SAMPLE_ROWS].astype(np.int32))]
    rows = sets.select("fp", F.posexplode("prefix").alias("pos", "s"), "n")
    held = F.array(*map(F.lit, heavy)).cast("array<int>")
    counted = scratch(sets.sparkSession, "counted")
    of = slices(sets.agg(F.sum(F.size("prefix"))).first()[0] or 0, SLICE_ROWS)
    for k in range(of):
        own = slice_of(rows, k, of, "s")
        known = own.where(F.array_contains(held, F.col("s"))) if len(heavy) <= 64 else own.join(F.broadcast(_ints(sets.sparkSession, heavy)), "s", "left_semi")
        others = own.where(~F.array_contains(held, F.col("s"))) if len(heavy) <= 64 else own.join(F.broadcast(_ints(sets.sparkSession, heavy)), "s", "left_anti")
        others = others.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("c > 1")
        both = keep(others.unionByName(known.withColumn("c", F.lit(1 + SAMPLE_ROWS // HEAVY).cast("long"))), counted)
    of = slices(both.count(), SLICE_ROWS)
    sketches = prints.select("fp", *[f"b{k}" for k in range(SKETCH)])
    for k in range(of):
        own = slice_of(both, k, of, "fp").join(slice_of(sketches, k, of, "fp"), "fp")
        lists = keep(own.withColumn("w", F.sum("c").over(Window.partitionBy("fp")) / F.col("n")).drop("c"), path)
    delete(sets.sparkSession, counted)
    return lists


def _ints(spark: SparkSession, values: list[int]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "s int")


def may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether two sets' sizes, what is left of them behind the shared place, and their sketches allow the similarity."""
    n, m, p, q = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    rest = 1 + F.least(n - p - 1, m - q - 1)
    unlike = reduce(add, [F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(SKETCH)])
    few = unlike <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6
    return (F.greatest(n, m) <= F.least(n, m) / similarity + 1e-6) & (rest >= similarity / (1 + similarity) * (n + m) - 1e-6) & few


def pairs_of(a: DataFrame, b: DataFrame, unlike: Column, similarity: float) -> DataFrame:
    """Distinct pairs (a, b), a below b, of sets in both tables that share a list and may be similar enough."""
    both = a.alias("x").join(b.alias("y"), (F.col("x.s") == F.col("y.s")) & unlike & may_be_similar("x", "y", similarity))
    return both.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def central_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """Each set with the CENTRAL sets of each of its lists whose shingles stand in the longest lists, for their size."""
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("w"), "fp"))
    first = lists.withColumn("rank", rank).where(F.col("rank") <= CENTRAL)  # cut before the shuffle, too
    return pairs_of(lists.drop("w"), first.drop("w", "rank"), F.col("x.fp") != F.col("y.fp"), similarity)


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b), a below b, that chain all sets (fp) whose SimHashes (sh) chains of at most two differing bits link.

    Sets of one SimHash are paired with the first of them, and firsts with each other along the BK-trees' links.
    """
    first = cut(prints.groupBy("sh").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("sets")))
    same = join_by_key(prints.select("sh", "fp"), first, "sh", "sets").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    linked = simhash.links(first.select(F.col("sh").alias("fp")))
    for c in ("a", "b"):
        linked = linked.join(first.select(F.col("sh").alias(c), F.col("first").alias(f"of_{c}")), c)
    linked = linked.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return same.unionByName(linked)


def open_pairs(lists: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """All pairs that share a list and stand in different groups (node, label); a set without a label is a group of its own.

    Of each such pair one at least is not in the list's largest group, so only those sets look for partners.
    """
    own = lists.join(groups.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("g", F.coalesce("label", "fp"))
    sizes = own.groupBy("s", "g").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("s").agg(F.max_by("g", F.struct("k", "g")).alias("main"), F.count(F.lit(1)).alias("gs")).where("gs > 1")
    path = scratch(lists.sparkSession, "open")
    own = keep(own.join(main.select("s", "main"), "s").drop("w", "label"), path)
    found = cut(pairs_of(own.where("g <> main"), own, F.col("x.g") != F.col("y.g"), similarity))
    delete(lists.sparkSession, path)
    return found


def verified(df: DataFrame, text_col: str, prints: DataFrame, candidates: DataFrame, similarity: float) -> DataFrame:
    """The candidates that are similar enough. Only texts that stand in a pair give their shingles again.

    Shingles are compared by 32 bits of their hashes, which halves what moves: a pair of a few hundred shingles
    is off by one of them once in some 400 000 pairs. Texts are found by their hashes, of which BROADCAST_ROWS are broadcast
    for each reading, so that no text is shuffled (above MOST_SLICES readings they are). Each pair brings two sets
    together; so many pairs are compared at once that these hold SLICE_INTS shingles or as many as all sets once.
    """
    spark = df.sparkSession
    uses = candidates.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("uses"))
    wanted = cut(uses.join(prints.select("fp", "h", "rows", "n"), "fp"))
    total, held, moved = (x or 0 for x in wanted.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("uses") * F.col("n"))).first())
    wanted = wanted.select("fp", "h", "rows")
    whole = text_function("s array<int>", lambda: lambda texts: ([np.unique(shingles_of(t).astype(np.int32)).tolist() for t in texts],))
    texts = df.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    path, of = scratch(spark, "sets"), -(-total * 5 // (BROADCAST_ROWS * 4)) if total > BROADCAST_ROWS else 1  # slices differ in size
    few, of = of <= MOST_SLICES, of if of <= MOST_SLICES else 1
    for k in range(of):
        own = slice_of(wanted, k, of, "h")
        known = keep(texts.join(F.broadcast(own) if few else own, "h").select("fp", "rows", whole(F.col("text"))["s"].alias("s")), path)
    copies = known.where("rows > 1").groupBy("fp").agg(F.first("s").alias("s"))  # sets of one row need no shuffle for it
    known = known.where("rows = 1").select("fp", "s").unionByName(copies)
    of, parts = slices(moved, max(SLICE_INTS, held)), []
    for k in range(of):
        own = slice_of(candidates, k, of, "a", "b")
        both = own.join(known.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(known.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
        both = both.select("a", "b", F.size("sa").alias("n"), F.size("sb").alias("m"), F.size(F.array_intersect("sa", "sb")).alias("i"))
        parts.append(cut(both.where(F.col("i") / (F.col("n") + F.col("m") - F.col("i")) >= similarity).select("a", "b")))
    delete(spark, path)
    return reduce(DataFrame.unionByName, parts)


def near_groups(df: DataFrame, text_col: str, sets: DataFrame, prints: DataFrame, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, label): the groups of sets that links of the similarity hold together; sets without a link are left out."""
    path = scratch(df.sparkSession, "lists")
    lists = listed(sets, prints, common, path)
    of = slices(lists.count(), SLICE_ROWS)
    parts = [cut(central_pairs(slice_of(lists, k, of, "s"), similarity)) for k in range(of)]
    first = cut(reduce(DataFrame.unionByName, parts, simhash_pairs(prints.select("fp", "sh"))).distinct())
    groups = cut(connected_components(verified(df, text_col, prints, first, similarity)))
    parts = [open_pairs(slice_of(lists, k, of, "s"), groups, similarity) for k in range(of)]
    delete(df.sparkSession, path)
    more = cut(reduce(DataFrame.unionByName, parts).distinct().join(first, ["a", "b"], "left_anti"))
    links = verified(df, text_col, prints, more, similarity)
    of = groups.select(F.col("node").alias("n"), F.col("label").alias("l"))
    for c in ("a", "b"):  # links between groups
        links = links.join(of, F.col(c) == F.col("n"), "left").withColumn(c, F.coalesce("l", c)).drop("n", "l")
    joined = cut(connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("to")))
    new = joined.select(F.col("label").alias("node"), F.col("to").alias("label")).join(groups.select("node"), "node", "left_anti")
    return groups.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(new)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df``, all columns: of each component of similar texts the one with the smallest id.

    Words are split at white space and compared in lower case. Null and empty texts equal each other and
    nothing else; texts of fewer words than a shingle are one shingle. Rows with a null id stay if nothing
    with an id is linked with them. Repeated rows stay; of a repeated id only the texts go that are linked
    with a smaller id.
    """
    common = df.sparkSession.sparkContext.broadcast(common_shingles(df, id_col, text_col))

    def sets():
        def f(texts: list) -> tuple:
            found = [shingles_of(t) for t in texts]
            prefixes = [list(dict.fromkeys(prefix_of(s, *common.value, similarity).astype(np.int32).tolist())) for s in found]
            keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in found), np.uint64, len(found)).view(np.int64)
            return keys.tolist(), list(map(simhash_of, found)), [len(s) for s in found], prefixes, *np.array([sketch_of(s) for s in found]).T.tolist()

        return f

    bits = [f"b{k}" for k in range(SKETCH)]
    x = text_function(f"fp long, sh long, n int, prefix array<int>, {', '.join(f'{b} long' for b in bits)}", sets)(F.col(text_col))
    key = F.col(id_col).cast("long") if dict(df.dtypes)[id_col] == "void" else F.col(id_col)  # columns have no such type
    whole, once = (scratch(df.sparkSession, name) for name in ("docs", "once"))
    docs = keep(df.select(key.alias("id"), F.xxhash64(text_col).alias("h"), x.alias("x")).select("id", "h", "x.*"), whole)
    prints = cut(docs.groupBy("fp").agg(F.min("id").alias("rep"), F.min("h").alias("h"), F.count(F.lit(1)).alias("rows"), F.min("sh").alias("sh"), F.min("n").alias("n"), *[F.any_value(b).alias(b) for b in bits]))
    sets_once = keep(docs.groupBy("fp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), once)  # copies meet before the shuffle
    docs = cut(docs.select("id", "h", "fp"))
    delete(df.sparkSession, whole)
    of = cut(near_groups(df, text_col, sets_once, prints, similarity, common.value))
    delete(df.sparkSession, once)
    slim = prints.select("fp", "rep", "rows")
    linked = cut(of.join(slim, of["node"] == slim["fp"]).select("fp", "label", "rep"))
    smallest = linked.groupBy("label").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("prints"))
    linked = join_by_key(linked.select("fp", "label"), smallest, "label", "prints").select("fp", "least")
    least = slim.join(linked, "fp", "left").select("fp", "rows", F.coalesce("least", "rep").alias("least"))
    gone = join_by_key(docs.select("id", "h", "fp"), cut(least), "fp", "rows").where(~F.col("id").eqNullSafe(F.col("least")))
    return without(df, gone.select("id", F.col("h").alias("mark")), id_col, F.xxhash64(df[text_col]))
