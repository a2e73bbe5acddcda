"""Sampling and splitting. Random order is the md5 of the seed and the key, so every pick can be repeated and checked."""

from __future__ import annotations

import bisect
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.labels import is_placeholder
from lexigrid.functions.text import pick_file
from lexigrid.operators.corpus import dense_ids
from lexigrid.session import cut


def hashed(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def block_shuffle(df: DataFrame, seed: int, source: str = "source") -> DataFrame:
    """Q1: the key that puts sources in random order; rows keep their order inside (sort by block, then the order column)."""
    return df.withColumn("block", hashed(seed, source))


#: Strata whose limits are broadcast at most: some 10 MB.
FEW_STRATA = 100_000
#: Leading digits of the hash that rows are counted by before any is ranked.
DIGITS = 3


def first_by_hash(df: DataFrame, strata: list[str], key: str, seed: int, quota: Column, name: str = "picked") -> DataFrame:
    """Adds ``name``: true for the first ``quota`` rows of each stratum in hash order (then key); quota may use n, the stratum's rows.

    Rows are counted by the hash's leading digits first. What lies before the digits in which the quota ends is
    in, what lies behind is out, and only rows with just these digits, about one in 16**DIGITS, are ranked. So no
    task holds a stratum. The limits are broadcast if there are at most FEW_STRATA of them, so that rows are not shuffled by
    their stratum; beyond that no stratum but a few can be large, and Spark splits these.
    """
    h = hashed(seed, key)
    rows = df.withColumns({"__h": h, "__b": F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("int")})
    keys = [F.col(c).alias(f"__s{k}") for k, c in enumerate(strata)]
    names = [f"__s{k}" for k in range(len(strata))]
    counts = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*names)
    counts = counts.withColumns({"n": F.sum("c").over(w), "before": F.sum("c").over(w.orderBy("__b")) - F.col("c")}).withColumn("__q", quota.cast("long"))
    edge = F.max_by(F.struct(F.col("__b").alias("b"), (F.col("__q") - F.col("before")).alias("left")), F.when(F.col("before") < F.col("__q"), F.col("__b")))
    limits = cut(counts.groupBy(*names).agg(edge.alias("__e")))
    limits = F.broadcast(limits) if limits.count() <= FEW_STRATA else limits
    cond = F.lit(True)
    for k, c in enumerate(strata):
        cond &= F.col(c).eqNullSafe(F.col(f"__s{k}"))
    joined = rows.join(limits, cond) if strata else rows.crossJoin(limits)  # one row without strata
    at = F.coalesce(F.col("__e.b"), F.lit(-1))
    apart = joined.where(F.col("__b") != at).withColumn(name, F.col("__b") < at)
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("__h", key))
    close = joined.where(F.col("__b") == at).withColumn(name, rank <= F.col("__e.left"))
    return apart.select(*df.columns, name).unionByName(close.select(*df.columns, name))


def n_per_group(df: DataFrame, n: int, groups: list[str], key: str, seed: int = 1) -> DataFrame:
    """Q15: n rows of each group."""
    return first_by_hash(df, groups, key, seed, F.lit(n), "__in").where("__in").drop("__in")


def random_subset(df: DataFrame, n: int, key: str, group: str | None = None, seed: int = 1) -> DataFrame:
    """Q13: n rows by hash; with ``group`` the same number of each, or n of all if some group has too few. Sort by key to show them."""
    if group:
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.min("n")).first()
        if sizes[0] and n % sizes[0] == 0 and sizes[1] >= n // sizes[0]:
            return n_per_group(df, n // sizes[0], [group], key, seed)
    return take_hashed(df, n, key, seed)


def next_pick(names: DataFrame, name: str = "name") -> DataFrame:
    """Q11: (inflection_type, next_pick) from the pick files' names: one more than the last pick."""
    x = names.select(pick_file(F.col(name)).alias("x")).where("x is not null")
    return x.groupBy("x.inflection_type").agg((F.max("x.pick") + 1).alias("next_pick"))


def take_hashed(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """Q14: n rows in hash order."""
    return df.orderBy(hashed(seed, key), key).limit(n)


def split_sources(sizes: DataFrame, ratio: float, seed: int, source: str = "source", stratum: str | None = None) -> DataFrame:
    """Q7, Q8: (source, split): in each stratum the first share by hash is test; sources stay whole."""
    strata = [stratum] if stratum else []
    out = first_by_hash(sizes, strata, source, seed, F.bround(F.col("n") * ratio), "__test")
    return out.select(source, *strata, F.when(F.col("__test"), "test").otherwise("train").alias("split"))


def sentence_stratum(rows: DataFrame, label: str, infl: str) -> DataFrame:
    """Q9: one row a sentence: its type and first label that is no placeholder, else ``unlabelled``."""
    real = F.when(~is_placeholder(F.col(label)), F.col("pos"))
    one = rows.groupBy("source", "sentence_id").agg(F.min(infl).alias("infl"), F.min_by(F.col(label), real).alias("l"), F.count(real).alias("n"))
    return one.select("source", "sentence_id", "infl", F.when(F.col("n") > 0, F.col("l")).otherwise("unlabelled").alias("label"))


def stratified_split(sents: DataFrame, strata: list[str], key: str, ratio: float, seed: int) -> DataFrame:
    """Q9: adds split. A stratum of one goes to train; of others round(size * ratio), half to even, at least 1 and at most size - 1, to test."""
    if not 0 <= ratio < 1:
        raise ValueError("ratio must be at least 0 and below 1")
    if ratio == 0:
        return sents.withColumn("split", F.lit("train"))
    quota = F.when(F.col("n") < 2, 0).otherwise(F.least(F.greatest(F.bround(F.col("n") * ratio), F.lit(1)), F.col("n") - 1))
    out = first_by_hash(sents, strata, key, seed, quota, "__test")
    return out.withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def gather_n_per_type(sizes: DataFrame, n: int, type_col: str = "first_type", source: str = "source") -> DataFrame:
    """Q12: whole sources of each type, in order of name, until n words are reached."""
    before = F.sum("words").over(Window.partitionBy(type_col).orderBy(source).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < n)


@dataclass(frozen=True)
class Packing:
    """What is taken of each size: (from the front, from the back) in the last round; in ``rounds`` rounds before it all items were."""

    rounds: int
    items: int
    total: int
    taken: dict[int, tuple[int, int]]

    def left(self, size: int, count: int) -> int:
        """Items of a size that are never taken."""
        return 0 if self.rounds else count - sum(self.taken.get(size, (0, 0)))


def pack_sizes(counts: dict[int, int], target: int) -> Packing:
    """Q3: how many items of each size are taken until their sizes reach the target, from the number of items of each size.

    The rule, item by item: take one of exactly the size that is wanted, the first of them; else one of the largest
    size below, the last of them; else the first of the smallest size; a pool that is used up is full again. It is
    followed in whole rounds and then in runs of one size: what is wanted only falls, so after a size below it has
    given what it can, no larger one can come up again, and one pass over the sizes downwards is the whole round. Steps
    are as many as there are distinct sizes, at most the square root of twice the sum of all sizes.
    """
    sizes = sorted(k for k, n in counts.items() if k > 0 and n > 0)
    if not sizes or target <= 0:
        return Packing(0, 0, 0, {})
    whole = sum(k * counts[k] for k in sizes)
    rounds = (target - 1) // whole
    rest, taken = target - rounds * whole, {}
    for size in reversed(sizes[: bisect.bisect_right(sizes, rest)]):
        last = min(counts[size], (rest - 1) // size)
        first = int(rest - last * size == size and last < counts[size])
        rest -= (last + first) * size
        if last or first:
            taken[size] = (first, last)
        if not rest:
            break
    if rest:  # all that is left is larger
        size = next(k for k in sizes if counts[k] > sum(taken.get(k, (0, 0))))
        first, last = taken.get(size, (0, 0))
        taken[size] = (first + 1, last)
        rest -= size
    items = rounds * sum(counts[k] for k in sizes) + sum(map(sum, taken.values()))
    return Packing(rounds, items, target - rest, taken)


def stratified_packings(counts: dict[str | None, dict[int, int]], target: int) -> tuple[dict[str | None, Packing], tuple[int, int] | None]:
    """Q2 from (kind, size) counts, kinds in their order: each kind's packing, and (size, number) that fills what they leave open.

    The target goes to the kinds in equal quotas, one more for the first ones if it doesn't divide; no kind is filled
    again. If their sum falls short, the items left over follow, largest first: all above the size that is returned and so
    many of it. None if nothing is to follow.
    """
    share, odd = divmod(target, max(1, len(counts)))
    packed = {kind: pack_sizes(n, min(share + int(k < odd), sum(size * c for size, c in n.items()))) for k, (kind, n) in enumerate(counts.items())}
    rest, left = target - sum(p.total for p in packed.values()), Counter()
    for kind, n in counts.items():
        left.update({size: packed[kind].left(size, c) for size, c in n.items()})
    more = None
    for size in sorted(left, reverse=True):
        if rest <= 0:
            break
        number = min(left[size], -(-rest // size))
        more, rest = (size, number), rest - number * size
    return packed, more


def sample_corpus(rows: DataFrame, target: int, mode: str = "source", stratified: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Word rows of the picked sources or sentences, and what was asked for and reached.

    The driver sees how many items there are of each size, or of each type and size, never an item. Items of one
    type and size are numbered in the order of their keys over ranges, and the numbers at either end are taken; repeated picks
    count once in rows. A stratified pick of sources (sentences are not stratified) is filled up by the largest
    sources left over, those of one size by name.
    """
    if mode not in ("source", "sentence"):
        raise ValueError(mode)
    spark, keys = rows.sparkSession, ["source"] if mode == "source" else ["source", "sentence_id"]
    kind = F.min("type") if stratified and mode == "source" else F.lit(None).cast("string")
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("words"), kind.alias("kind")))
    counts: dict[str | None, dict[int, int]] = {r["kind"]: {} for r in sizes.groupBy("kind").agg(F.min("source").alias("o")).orderBy("o").collect()}
    for r in sizes.groupBy("kind", "words").count().collect():
        counts[r["kind"]][r["words"]] = r["count"]
    more = None
    if stratified and mode == "source":
        packed, more = stratified_packings(counts, target)
    else:
        packed = {k: pack_sizes(n, target) for k, n in counts.items()}
    limits = [(k, size, n if p.rounds else first, n if p.rounds else n - last) for k, p in packed.items() for size, n in counts[k].items() for first, last in [p.taken.get(size, (0, 0))]]
    bounds = spark.createDataFrame(limits, "__kind string, __words long, upto long, since long")
    numbered = dense_ids(sizes, ["kind", "words", *keys], "__id")
    least = numbered.groupBy(F.col("kind").alias("__kind"), F.col("words").alias("__words")).agg(F.min("__id").alias("__least"))
    bounds = bounds.join(least, bounds["__kind"].eqNullSafe(least["__kind"]) & (bounds["__words"] == least["__words"])).drop(least["__kind"], least["__words"])
    placed = numbered.join(bounds, F.col("kind").eqNullSafe(F.col("__kind")) & (F.col("words") == F.col("__words"))).withColumn("at", F.col("__id") - F.col("__least"))
    inside = F.expr("at < upto or at >= since")
    picks, items, got = placed.where(inside).select(*keys), sum(p.items for p in packed.values()), sum(p.total for p in packed.values())
    if more:
        left = cut(placed.where(~inside).select(*keys, "words"))
        same = dense_ids(left.where(F.col("words") == more[0]), keys, "__k").where(F.col("__k") < more[1])
        above = left.where(F.col("words") > more[0])
        extra = above.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
        items, got = items + extra[0] + more[1], got + extra[1] + more[0] * more[1]
        picks = picks.unionByName(above.select(*keys)).unionByName(same.select(*keys))
    return rows.join(picks, keys, "left_semi"), {"requested": target, "achieved": got, "rounds": max((p.rounds for p in packed.values()), default=0), "items": items}


def mix_corpora(corpora: dict[str, DataFrame], target: int, shares: dict[str, float] | None = None, mode: str = "source", stratified: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """Q5: each corpus sampled to round(target * share); rows carry the corpus and its sampling rounds."""
    shares = shares or {k: 1 / len(corpora) for k in corpora}
    if abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError("shares must sum to 1")
    out, reports = None, {}
    for name, rows in corpora.items():
        part, reports[name] = sample_corpus(rows, round(target * shares[name]), mode, name in stratified)
        part = part.withColumns({"orig_corpus": F.lit(name), "sample_round": F.lit(reports[name]["rounds"]), "sampling_mode": F.lit(mode)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, reports


def pick_per_type(sents: DataFrame, n: int, seed: int = 1, type_col: str = "inflection_type", text: str = "text") -> DataFrame:
    """Q10: n texts of each type, no text twice: a text counts for the type where it stands first by hash."""
    own = Window.partitionBy(text).orderBy(hashed(seed, type_col, text), type_col)
    once = sents.select(type_col, text).distinct().withColumn("__r", F.row_number().over(own)).where("__r = 1").drop("__r")
    return n_per_group(once, n, [type_col], text, seed)


def majority_baseline(df: DataFrame, label: str, group: str | None = None) -> DataFrame:
    """Q16: the most common label, over all rows or in each group; ties by label."""
    g = [group] if group else []
    n = df.groupBy(*g, label).agg(F.count("*").alias("n"))
    best = F.min_by(F.col(label), F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("pred_label")
    return n.groupBy(*g).agg(best) if g else n.agg(best)


def uniform_baseline(df: DataFrame, key: str, labels: list[str], seed: int = 1) -> DataFrame:
    """Q16: a label for each row by the hash of its key."""
    k = F.conv(F.substring(hashed(seed, key), 1, 8), 16, 10).cast("long") % len(labels)
    return df.withColumn("pred_label", F.element_at(F.array(*map(F.lit, labels)), k.cast("int") + 1))
