"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexigrid.session import cut, shared_folder  # noqa: F401  shared by the operators

#: Rows handed to Python code at once, and rows of an Arrow batch at most: both bound a worker's memory where texts are long.
CHUNK_ROWS = 256
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone (any store it can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of at most two longs and a digest that are broadcast at most: under 16 MB.
BROADCAST_ROWS = 200_000
#: A key with more than 1/HEAVY of a side's rows is joined by broadcast; there are under HEAVY of them.
HEAVY = 1024


def without(df: DataFrame, gone: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The rows of ``df`` whose (id, mark) does not stand in ``gone`` (columns id, mark); null ids are equal.

    ``gone`` is broadcast if it has at most BROADCAST_ROWS rows, so that no text is shuffled, and the mark is
    computed only where the id is found; above that rows are dealt by id and mark.
    """
    gone = cut(gone.select(F.col("id").alias("__gone"), F.col("mark").alias("__mark")).distinct())
    # rows without an id are looked up by their mark, so that they don't meet the marks of all others
    alone = F.when(df[id_col].isNull(), mark).eqNullSafe(F.when(gone["__gone"].isNull(), gone["__mark"]))
    same = df[id_col].eqNullSafe(gone["__gone"]) & alone
    if gone.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(gone), same & F.coalesce(mark == gone["__mark"], F.lit(False)), "left_anti")
    return df.join(gone, same & (mark == gone["__mark"]), "left_anti")


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``facts``, one row a key, where column ``count`` of ``facts`` is the number of its rows.

    Keys that hold more than 1/HEAVY of all rows are joined by broadcast, the others by a shuffle.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    heavy = cut(facts.where(F.col(count) * HEAVY > total))
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(heavy), key).unionByName(light).drop(count)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_order(id_col: str, seed: int = 17) -> Column:
    """A uniform number in [0, 1) fixed by the id: for documented, repeatable samples."""
    return (F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def bound_batches() -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows; batches that are smaller already stay."""
    spark, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def text_function(ddl: str, setup: Callable[[], Callable[[list], Sequence[list]]]) -> Callable[[Column], Column]:
    """An Arrow-batched function of one column that returns a struct of ``ddl``.

    ``setup`` runs once a task and returns ``f(values) -> one list a field``. Values arrive as Python
    objects, None for null.
    """
    bound_batches()
    schema = struct_type(ddl)
    fields = list(to_arrow_schema(schema))

    @F.arrow_udf(returnType=schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = setup()
        for batch in batches:
            done = []
            for at in range(0, len(batch), CHUNK_ROWS):
                columns = f(batch.slice(at, CHUNK_ROWS).to_pylist())
                done.append(pa.StructArray.from_arrays([pa.array(c, x.type) for c, x in zip(columns, fields, strict=True)], fields=fields))
            yield pa.concat_arrays(done) if done else pa.array([], pa.struct(fields))

    return run


def map_chunks(df: DataFrame, columns: Sequence[str | Column], ddl: str, setup: Callable[[], Callable[..., Iterator]], chunk: int = CHUNK_ROWS) -> DataFrame:
    """Rows to rows: ``setup()`` once a task, its function once a chunk of rows.

    The function gets one list a column and yields tuples of lists or Arrow arrays (one a field of ``ddl``);
    called with no argument after the last chunk, it may yield what it has kept.
    """
    bound_batches()
    schema = struct_type(ddl)
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup()
        column = lambda c, kind: c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, kind)
        wrap = lambda out: pa.RecordBatch.from_arrays([column(c, x.type) for c, x in zip(out, fields, strict=True)], schema=fields)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                for out in f(*[c.to_pylist() for c in part.columns]):
                    yield wrap(out)
        for out in f():
            yield wrap(out)

    return df.select(*columns).mapInArrow(run, schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph, as (node, label); label is the component's smallest node.

    Alternating large-star and small-star rounds on the edge table: every round is two aggregations and
    two joins, cut by a checkpoint; a hub is split by adaptive skew handling and never gathered. Nodes
    that have no edge are not returned. Self-loops and nulls are ignored, repeated edges collapse. A graph that
    is not finished after ``most_rounds`` is an error; rounds grow with the logarithm of a component's size.
    """
    cur = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = cut(small.select(F.col("e.u").alias("u"), F.col("e.v").alias("v")).where("u <> v").distinct())
        now = tuple(cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not finished after {most_rounds} rounds")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
