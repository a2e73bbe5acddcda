"""Exact dedup with a heavy-hitter split (operator 1), in DataFrame and SQL functions only.

A Misra-Gries summary (Spark's frequent-items sketch) finds digests that may hold more than 1/heavy of
all rows; an exact count verifies them. Their winners, at most ``heavy`` rows, are broadcast, and rows
of those groups get their decision map-side. All other digests take one ordinary shuffle of
(id, digest), in which no group can hold more than 1/heavy of the rows. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import cut, without

#: Groups of more than 1/HEAVY of all rows are heavy; at most HEAVY winners are broadcast.
HEAVY = 4096
#: Counters of the summary. Its error is below 1/HEAVY of the rows.
TRACKED = 65536

#: Fixed value: the white space that counts as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their SHA-256 after white-space normalisation is. The row with the smallest id
    stays. Null texts count as empty. A null id never wins against another id; a group of null ids only
    has keep_id null and stays. Rows that repeat a group's smallest id are one document given twice and
    all stay. Other columns are ignored, so their names cannot clash. An empty table gives no rows.
    """
    both = decisions(df, id_col, text_col, heavy, tracked)
    return both.select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def decisions(df: DataFrame, id_col: str, text_col: str, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(digest, doc_id, keep_id, group_size), one row per input row."""
    slim = cut(df.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest")))
    winners = cut(heavy_winners(slim, heavy, tracked))
    hit = slim.join(F.broadcast(winners), "digest")
    one = Window.partitionBy("digest")
    rest = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "doc_id", F.min("doc_id").over(one).alias("keep_id"), F.count(F.lit(1)).over(one).alias("group_size")
    )
    return hit.select("digest", "doc_id", "keep_id", "group_size").union(rest)


def heavy_winners(slim: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """(digest, keep_id, group_size) of every digest with more than 1/heavy of the rows: under ``heavy`` rows."""
    found = slim.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(hex(digest), {heavy}, {tracked})").alias("top"))
    found = found.select("n", F.explode("top").alias("x")).where(F.col("x.count") * heavy > F.col("n"))
    found = cut(found.select(F.unhex("x.item").alias("digest"), "n"))
    exact = slim.join(F.broadcast(found), "digest").groupBy("digest", "n").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return exact.where(F.col("group_size") * heavy > F.col("n")).select("digest", "keep_id", "group_size")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, without those whose text another row keeps.

    Rows go by id and text, so of a repeated id only the texts go that another id keeps. Rows with a null id
    stay if no other id has their text; rows that repeat a kept row stay. Null texts count as empty. An empty
    table stays empty; columns of any name are kept.
    """
    gone = decisions(df, id_col, text_col).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return without(df, gone.select(F.col("doc_id").alias("id"), F.col("digest").alias("mark")), id_col, digest_of(df[text_col]))
