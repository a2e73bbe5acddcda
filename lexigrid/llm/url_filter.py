"""URL filter: blocked Bloom filter, then an exact hash join (operator 5).

Every URL is tested against the short list of prefix rules (host, path) row by row. URLs that no rule fits
are looked up among the listed URLs by their canonical form: a blocked Bloom filter, one 512-bit block a
form, passes forms that may be listed; an exact hash join with the list removes the false positives. Only
forms that passed are counted and shuffled, once each. The filter's size has a bound whatever the list's:
a longer list passes more forms, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import HEAVY, cut

#: The rules of the policy, as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: The filter's most bytes (it is broadcast), and its bits for each key up to there.
FILTER_BYTES = 8 << 20
KEY_BITS = 16
PROBES = 8
#: Verified hits are broadcast up to so many bytes.
HIT_BYTES = 8 << 20


def default_listed(spark: SparkSession) -> DataFrame:
    """A block list made by rule: numbered pages of gambling hosts under three domains in four languages."""
    n = spark.range(3 * 4 * 10_000).select((F.col("id") % 3).alias("d"), (F.floor(F.col("id") / 3) % 4).alias("l"), F.floor(F.col("id") / 12).alias("p"))
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), F.col(k).cast("int") + 1)
    host = F.concat(F.lit("casino-win.example."), pick(["com", "net", "org"], "d"))
    return n.select(F.concat(host, F.lit("/"), pick(["en", "de", "fr", "es"], "l"), F.lit("/"), F.col("p").cast("string")).alias("url"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m. and a default port, path without index page, .html and closing slashes."""
    host = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", ""))


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """(rule, verdict) of the rule that fits with the longest host and path, then host; null if none does. Of equal rules block stands."""
    best = None
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        said = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, said) if best is None else F.when(fits, said).otherwise(best)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if best is None else best


def listed_keys(listed: DataFrame) -> DataFrame:
    """The canonical forms (key) of the listed URLs."""
    full = F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("http://"), "url"))
    return listed.where("url is not null").select(canonical(host_of(full), path_of(full)).alias("key")).distinct()


def bloom_blocks(keys: DataFrame, most_bytes: int = FILTER_BYTES) -> np.ndarray:
    """The filter of all keys, (blocks, 8) words of 64 bits. The blocks are or-ed on the executors."""
    n = keys.count()
    blocks = max(1, min(most_bytes // 64, -(-n * KEY_BITS // 512)))
    h = F.xxhash64("key")
    bit = F.explode(F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(j), "key"), 32).bitwiseAND(F.lit(511)) for j in range(PROBES)]))
    words = keys.select(F.pmod(h, F.lit(blocks)).alias("block"), bit.alias("bit"))
    words = words.groupBy("block", F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    out = np.zeros((blocks, 8), np.int64)
    for r in words.toLocalIterator():  # at most 8 rows a block: bounded by most_bytes
        out[r["block"], r["word"]] = r["bits"]
    return out


def may_hold(spark: SparkSession, filter_words: np.ndarray):
    """A function of (block hash, probe hashes): false only for keys that the filter was not given."""
    shared = spark.sparkContext.broadcast(filter_words)

    @F.arrow_udf("boolean")
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = shared.value
        for h, bits in batches:
            block = words[np.mod(h.to_numpy(zero_copy_only=False), len(words))]
            at = bits.flatten().to_numpy(zero_copy_only=False).reshape(-1, PROBES)
            hit = block[np.arange(len(at))[:, None], at >> 6] >> (at & 63) & 1
            yield pa.array(hit.all(axis=1))

    return probe


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, listed: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, canonical_url.

    Rules are a short list and are tested row by row. The rule with the longest host and path wins, then the
    one with the longer host. URLs that no rule fits are blocked if their canonical form is listed, else
    allowed: of these, the filter's possible hits alone are counted by their form and joined with the list.
    A null URL, or one without ``://``, has an empty host and path and is allowed. Repeated rows and null ids
    stay as they are; URLs of any length are judged whole; an empty table gives an empty one; other columns are ignored,
    whatever their names.
    """
    spark = df.sparkSession
    keys = cut(listed_keys(default_listed(spark) if listed is None else listed))
    probe = may_hold(spark, bloom_blocks(keys))
    pages = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    pages = pages.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("x"), canonical(F.col("host"), F.col("path")).alias("canonical_url"))
    key = F.col("canonical_url")
    bits = F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(j), key), 32).bitwiseAND(F.lit(511)) for j in range(PROBES)])
    asked = F.col("x").isNull() & (F.col("host") != "")
    possible = pages.where(asked).select(key.alias("key"), F.xxhash64(key).alias("h"), bits.alias("bits")).where(probe(F.col("h"), F.col("bits")))
    hits = cut(possible.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).join(keys.hint("shuffle_hash"), "key"))
    hits = hits.select(F.col("key").alias("hit"), "rows")
    out = pages.withColumn("hit", F.when(asked, key))
    rows, size = hits.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.octet_length("hit") + 64), F.lit(0))).first()
    if size <= HIT_BYTES:
        out = out.join(F.broadcast(hits.withColumn("listed", F.lit(True))), "hit", "left")
    else:  # under HEAVY forms have more than 1/HEAVY of the hits; the others are joined by a shuffle, rows without a form stay put
        heavy = cut(hits.where(F.col("rows") * HEAVY > rows))
        out = out.join(F.broadcast(heavy.select("hit", F.lit(True).alias("often"))), "hit", "left")
        rest = out.where(F.col("often").isNull() & F.col("hit").isNotNull()).join(hits.withColumn("listed", F.lit(True)), "hit", "left").drop("often", "rows")
        out = out.where(F.col("often").isNotNull() | F.col("hit").isNull()).withColumnRenamed("often", "listed").unionByName(rest)
    verdict = F.coalesce("x.verdict", F.when(F.col("listed"), "block"), F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("x.rule").alias("rule"), verdict.alias("verdict"), "canonical_url")
