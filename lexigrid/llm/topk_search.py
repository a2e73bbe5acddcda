"""Exact top-k search by inner product over sorted lists, without random access (operator 11).

Distinct vectors are dealt into shards of a few thousand. A shard sorts its vectors by each component, so that for a
query every component is a list of contributions in descending order, read from one end or the other by the
query's sign. All lists are read in steps. Of each vector the sum of contributions seen so far is kept, and what is
unseen is bounded twice: by the lists' last values, and by the lengths of the unseen parts of both vectors (Cauchy and
Schwarz). The k-th best lower bound is the score to reach; reading stops when no vector that has not been seen can reach
it and few that have been seen can. Those few get their final scores, so that the result is exact.

Queries go out in blocks of bounded size, each broadcast once; no row meets the driver otherwise. What one shard gives for
a block is the bar that all others start with, and scores that a task has found raise it for its later shards. A task
gives out k rows a query, and Spark merges them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import cut
from lexigrid.session import scratch

K = 5
SCALE = 256
#: Vectors of a shard and queries of a block, on average; both are dealt by hash.
SHARD_ROWS = 4096
QUERY_ROWS = 8192
#: Steps in which a list is read, and the share of a shard that gets final scores at most before the lists' ends.
STEPS = 16
FEW = 1 / 4


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector or a component is null or not finite.

    So it is where a sum of products might leave a long: above the square root of 2**63 / n components.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    most = F.sqrt(F.lit(float(2**63 - 2**40)) / F.greatest(F.size(vector), F.lit(1)))
    fit = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < most - 1), F.lit(False)))
    return F.when(fit, whole)


class Shard:
    """Vectors with each component's order, from either end."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]]) -> None:
        self.vectors, self.ids = vectors, ids
        up = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        values = np.take_along_axis(vectors, up, 0).astype(np.float64)
        self.order, self.sorted = (np.ascontiguousarray(up[::-1]), up), (np.ascontiguousarray(values[::-1]), values)
        self.squares = (vectors.astype(np.float64) ** 2).sum(1)
        self.exact = float(np.abs(vectors).max(initial=0)) ** 2 * max(1, vectors.shape[1]) < 2**52
        self.floats = vectors.astype(np.float64) if self.exact else None

    def final(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products in whole numbers."""
        if self.exact and float(np.abs(query).max(initial=0)) ** 2 * max(1, len(query)) < 2**52:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows].astype(np.int64) @ query.astype(np.int64)

    def live(self, query: np.ndarray, bar: float, k: int) -> np.ndarray:
        """The vectors that may be among the k + 1 best and reach ``bar``, read from the sorted lists.

        Where a bar is known, the lists are read at once to where no unseen vector reaches it. Where there is none, the
        lower bounds by lengths make one.
        """
        n, wide = self.vectors.shape
        weight = query.astype(np.float64)
        if not wide or n <= 2 * k + 2:
            return np.arange(n)
        down, lists = weight > 0, np.arange(wide)
        last = np.where(down, self.sorted[0][-1], self.sorted[1][-1]) * weight  # the least of each list
        step = -(-n // STEPS)
        fronts = np.where(down, self.sorted[0][step - 1 :: step], self.sorted[1][step - 1 :: step]) * weight
        blind, at = not math.isfinite(bar), 0
        to = 2 * step if blind else step * (1 + int(np.argmax(fronts.sum(1) < bar))) if (fronts.sum(1) < bar).any() else n
        seen, count, mine = np.zeros((n, wide), np.float32), np.zeros(n), np.arange(n)
        squares, of_query = (self.squares.copy(), np.full(n, (weight**2).sum())) if blind else (None, None)
        slack = 1e-6 * (1 + float(np.abs(weight).max()))
        while True:
            to = min(to, n)
            rows = np.where(down, self.order[0][at:to], self.order[1][at:to])
            values = np.where(down, self.sorted[0][at:to], self.sorted[1][at:to])
            flat = rows.ravel()
            count += np.bincount(flat, (values * weight).ravel(), n)
            seen.ravel()[(rows * wide + lists).ravel()] = 1
            if blind:
                squares -= np.bincount(flat, (values * values).ravel(), n)
                of_query -= np.bincount(flat, np.broadcast_to(weight**2, rows.shape).ravel(), n)
            front = values[-1] * weight
            unread = front.sum()  # the most that a vector has that no list has shown yet
            margin = slack + 1e-5 * (np.abs(front).sum() + np.abs(last).sum())  # sums over what is seen are in single precision
            upper = count[mine] + unread - seen[mine] @ front.astype(np.float32) + margin
            if blind:
                length = np.sqrt(np.maximum(squares[mine], 0) * np.maximum(of_query[mine], 0)) + slack
                upper = np.minimum(upper, count[mine] + length)
                lower = count[mine] + np.maximum(last.sum() - seen[mine] @ last.astype(np.float32) - margin, -length)
                if len(mine) > k:
                    bar = max(bar, float(np.partition(lower, len(mine) - k - 1)[len(mine) - k - 1]))
            keep = upper >= bar
            if unread < bar or to == n:  # what has not been seen falls out as well
                mine = mine[keep & seen[mine].any(1)] if to < n else mine[keep]
                if to == n or len(mine) <= max(2 * k + 2, FEW * n):
                    return mine
            at, to = to, to + step * (2 if blind else 1)

    def best(self, query: np.ndarray, own: int | None, bar: float, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but the query's own, ties by id."""
        rows = self.live(query, bar, k)
        scores = self.final(rows, query)
        if len(rows) > k + 1:
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            rows, scores = rows[scores >= least], scores[scores >= least]
        found = []
        for r, s in zip(rows.tolist(), scores.tolist(), strict=True):
            ids = self.ids[r]
            if own in ids and np.array_equal(self.vectors[r], query):
                ids = list(ids)
                ids.remove(own)
            found += [(-s, i) for i in ids[:k]]
        return [(-s, i) for s, i in sorted(found)[:k]]


def search(shards: Iterator[Shard], queries: tuple[np.ndarray, np.ndarray, np.ndarray], bars: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of all shards for each query (keys, ids, vectors) that reach its bar."""
    keys, ids, vectors = queries
    best: list[list[tuple[int, int]]] = [[] for _ in keys]
    for shard in shards:
        for n, (own, query) in enumerate(zip(ids.tolist(), vectors, strict=True)):
            bar = max(float(bars[n]), float(best[n][-1][0]) if len(best[n]) == k else -math.inf)
            if new := shard.best(query, own, bar, k):
                best[n] = sorted(best[n] + new, key=lambda x: (-x[0], x[1]))[:k]
    rows = [(q, s, i) for q, found in zip(keys.tolist(), best, strict=True) for s, i in found]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "score", "id"])


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Rows (shard, ids, vector) in the order of shards."""
    held: list[pa.RecordBatch] = []

    def made() -> Shard:
        t = pa.Table.from_batches(held)
        flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return Shard(flat.reshape(t.num_rows, -1), t["ids"].to_pylist())

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        ends = [*(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            if held and held[-1].column("shard")[-1].as_py() != shard[lo]:
                yield made()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield made()


def top_k(df: DataFrame, query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): for each row of which ``query`` is true the k rows of greatest integer inner product.

    Candidates are all rows but the query's own, ties go to the smaller id, ranks begin at 1. Rows take no part if their
    id is null, or their vector is null or holds a null, a component that is not finite or one beyond ``quantised``'s
    bound. Vectors of another number of components than the query's are no candidates; vectors of none score 0 with each
    other. Rows that repeat an id are rows of their own: each is a query, and each is found. Fewer than k candidates are
    all given. An empty table gives an empty one; columns other than the two are ignored, whatever their names.

    Equal vectors go as one with their k + 1 smallest ids, as no query can need more; a hot vector is cut to them
    before the shuffle.
    """
    spark, empty = df.sparkSession, None
    taken = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("v"), F.coalesce(query, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = taken.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(classes.withColumn("size", F.size("v")))
    asked = cut(taken.where("asks").select("id", "v", F.size("v").alias("size")))
    asked = asked.withColumn("q", F.monotonically_increasing_id())  # a checkpoint's rows keep their places
    found = []
    for size, rows, ids in sorted(map(tuple, classes.groupBy("size").agg(F.count(F.lit(1)), F.first("ids")).collect())):  # one row a number of components
        own, mine = asked.where(F.col("size") == size), classes.where(F.col("size") == size)
        blocks, shards = -(-own.count() // QUERY_ROWS), -(-rows // SHARD_ROWS)
        dealt = mine.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "ids", "v")
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
        dealt = cut(dealt)
        for b in range(blocks):
            block = own.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "id", "v").toArrow()
            vectors = block["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, size)
            sent = spark.sparkContext.broadcast((block["q"].to_numpy(), block["id"].to_numpy(), vectors))

            def of(some: DataFrame, bars: np.ndarray, sent=sent) -> DataFrame:
                return some.mapInArrow(lambda batches: search(shards_of(batches), sent.value, bars, k), "q long, score long, id long")

            bars = np.full(block.num_rows, -np.inf)
            first = of(dealt.where("shard = 0"), bars).toArrow()  # k rows a query of the block at most
            if shards > 1:
                score, place = first["score"].to_numpy(), np.searchsorted(np.sort(keys := block["q"].to_numpy()), first["q"].to_numpy())
                worst, number = np.full(len(keys), np.inf), np.bincount(place, minlength=len(keys))
                np.minimum.at(worst, place, score)
                bars[np.argsort(keys)] = np.where(number >= k, worst, -np.inf)
                part = of(dealt.where("shard > 0"), bars)
                if blocks > 1:
                    part.write.parquet(path := scratch(spark, "top-k"))
                    part = spark.read.parquet(path)
                found.append(part)
            found.append(spark.createDataFrame(first) if first.num_rows else spark.createDataFrame([], "q long, score long, id long"))
    for part in found:
        empty = part if empty is None else empty.unionByName(part)
    if empty is None:
        empty = spark.createDataFrame([], "q long, score long, id long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = empty.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", F.col("id").alias(id_col), "score")
