"""Spans and sequences: chunks, interval joins, islands, and the diff of two annotation layers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

ENDS = ".!?"


def chunk_spans(text: str, most: int = 1000) -> list[tuple[int, int]]:
    """Half-open spans of at most ``most`` characters, each backed up to its last sentence end.

    A text shorter than ``most`` is one span. The last piece is backed up too, so that what follows its
    last sentence end is a span of its own; white space between spans belongs to none.
    """
    if len(text) < most:
        return [(0, len(text))] if text else []
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        mark = max(text.rfind(c, at, end) for c in ENDS)
        if mark > at + 1:
            end = mark + 1
        out.append((at, end))
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1000) -> DataFrame:
    """(id, chunk, start, end, piece) of every document; null and empty texts give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(f["i"], f["t"], strict=True) for k, (s, e) in enumerate(chunk_spans(t or "", most))]
            yield pd.DataFrame(rows, columns=["i", "chunk", "start", "end", "piece"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"i {kind}, chunk int, start int, end int, piece string")
    return out.withColumnRenamed("i", id_col)


def piece_offsets(text: str, pieces: list[str], mark: str = "▁") -> list[tuple[int, int] | None]:
    """Spans of subword pieces found by walking the text; pieces in angle or square brackets are special and have none."""
    out, at = [], 0
    for p in pieces:
        if len(p) > 2 and p[0] + p[-1] in ("<>", "[]"):
            out.append(None)
            continue
        body = p.replace(mark, "")
        while at < len(text) and text[at].isspace():
            at += 1
        out.append((at, at + len(body)))
        at += len(body)
    return out


def word_spans(rows: DataFrame) -> DataFrame:
    """Start and end of each word in its sentence's text (words joined by one blank), without a join."""
    w = Window.partitionBy("source", "sentence_id").orderBy("pos")
    before = F.coalesce(F.sum(F.length("word") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", before).withColumn("end", F.col("start") + F.length("word"))


#: Width of the bins, in characters, by which intervals of one document meet.
BIN = 512


def binned(df: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """One row for each bin that the closed interval touches, with ``name`` its bin and __{name} the first one."""
    first, last = F.floor(F.col(lo) / BIN), F.floor(F.greatest(F.col(lo), F.col(hi)) / BIN)
    return df.withColumn(f"__{name}", first).withColumn(name, F.explode(F.sequence(first, last)))


def overlaps(words: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of a word and a token of the same document by the mapping rule; (key, w_*, b_*).

    Both meet by document and bin, so a long document is many small joins; a pair counts in the bin where
    the later of the two begins.
    """
    w = binned(words.select(key, F.col("start").alias("w_start"), F.col("end").alias("w_end")), "w_start", "w_end", "bw")
    b = binned(tokens.select(key, F.col("start").alias("b_start"), F.col("end").alias("b_end")), "b_start", "b_end", "bb")
    inside = (F.col("b_start") < F.col("w_end")) & (F.col("w_end") < F.col("b_end"))
    closes = (F.col("b_start") <= F.col("w_end")) & (F.col("w_start") < F.col("b_end")) & (F.col("b_end") <= F.col("w_end"))
    both = w.withColumnRenamed("bw", "__bin").join(b.withColumnRenamed("bb", "__bin"), [key, "__bin"])
    return both.where((inside | closes) & (F.col("__bin") == F.greatest("__bw", "__bb"))).drop("__bin", "__bw", "__bb")


def token_at(tokens: DataFrame, points: DataFrame, key: str = "doc_id", point: str = "x") -> DataFrame:
    """The first token that covers the point, null if none does. Both meet by document and bin."""
    t = binned(tokens.select(key, "start", "end"), "start", "end", "__bin").drop("____bin")
    hit = points.withColumn("__bin", F.floor(F.col(point) / BIN)).join(t, [key, "__bin"]).where((F.col("start") <= F.col(point)) & (F.col(point) < F.col("end")))
    first = hit.groupBy(key, point).agg(F.min(F.struct("start", "end")).alias("token"))
    return points.join(first, [key, point], "left").select(*points.columns, "token.start", "token.end")


def context(rows: DataFrame, hit: Column, width: int = 8, by: tuple[str, ...] = ("source", "sentence_id"), word: str = "word", order: str = "pos") -> DataFrame:
    """Rows where ``hit`` holds, with the words up to ``width`` places before and after."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-width, width)
    return rows.withColumn("context", F.array_join(F.collect_list(word).over(w), " ")).where(hit)


def islands(df: DataFrame, same: Column, by: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Number runs of rows that hang together with the row before (``same`` may use lag over the window)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(name, F.sum("__new").over(w)).drop("__new")


def merge_tags(tokens: DataFrame, by: list[str], order: str = "pos", tag: str = "tag", word: str = "word", sentence: str | None = None, joined: str = "|") -> DataFrame:
    """Phrases of B-/I-/O tags: an I- tag goes on only from the same type; (by, start, end, type, phrase).

    ``tag`` may be an array of several tags of a token: they count in their order as text, so a B- one decides, the
    token's first type must be the last one of the token before, and a phrase's types are joined. With ``sentence`` an
    I- tag at the beginning of a sentence begins a phrase too; else phrases go on over sentences. Tokens without a tag
    are left out.
    """
    w = Window.partitionBy(*by).orderBy(order)
    several = isinstance(tokens.schema[tag].dataType, ArrayType)
    tags = F.sort_array(F.array_distinct(F.array_compact(F.col(tag)))) if several else F.array(tag)
    t = tokens.where(F.size(tags) > 0 if several else F.col(tag).isNotNull()).withColumn("__t", tags)
    t = t.withColumn("__k", F.transform("__t", lambda x: F.regexp_replace(x, "^[BI]-", "")))
    t = t.withColumn("__prev", F.lag(F.element_at("__k", -1)).over(w))
    same = F.col("__t")[0].startswith("I-") & (F.col("__prev") == F.col("__k")[0])
    if sentence:
        t = t.withColumn("__s", F.lag(sentence).over(w))
        same &= F.col("__s").eqNullSafe(F.col(sentence))
    t = islands(t, same, by, [order]).where(F.col("__t")[0] != "O")
    parts = F.sort_array(F.collect_list(F.struct(order, word)))
    kinds = F.array_remove(F.array_distinct(F.flatten(F.collect_list("__k"))), "O")
    return t.groupBy(*by, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.array_join(F.sort_array(kinds), joined).alias("type"), F.array_join(F.transform(parts, lambda p: p[word]), " ").alias("phrase")).drop("island")


def join_touching(spans: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Spans of the same type that touch, letters or digits on both sides, become one; text parts are joined."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    s = spans.withColumns({"__e": F.lag("end").over(w), "__t": F.lag("type").over(w), "__x": F.lag(text).over(w)})
    same = (F.col("__e") == F.col("start")) & (F.col("__t") == F.col("type")) & F.col("__x").rlike(r"[\p{L}\p{N}]$") & F.col(text).rlike(r"^[\p{L}\p{N}]")
    s = islands(s, same, by, ["start", "end"])
    parts = F.sort_array(F.collect_list(F.struct("start", F.col(text).alias("x"))))
    return s.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("type").alias("type"), F.array_join(F.transform(parts, lambda p: p["x"]), "").alias(text)).drop("island")


def shared_groups(words: DataFrame, by: list[str], order: str = "pos", tokens: str = "tokens") -> DataFrame:
    """Consecutive words that share a token get one group."""
    w = Window.partitionBy(*by).orderBy(order)
    t = words.withColumn("__p", F.lag(tokens).over(w))
    return islands(t, F.arrays_overlap(F.col("__p"), F.col(tokens)), by, [order], "grp").drop("__p")


def subtoken_pointer(rows: DataFrame, by: list[str], order: str = "pos", n: str = "n_tokens") -> DataFrame:
    """Place of each word's first subtoken, where place 0 is the sentence's start token."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pointer", 1 + F.coalesce(F.sum(n).over(w), F.lit(0)))


def layer_diff(old: DataFrame, new: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Spans of two layers with one annotation each: status COMMON, MODIFIED, MISSING (old only) or EXTRA (new only).

    ``matching`` and ``mismatching`` list the attributes that agree and differ.
    """
    a = old.select(*keys, F.struct(*attributes).alias("a"))
    b = new.select(*keys, F.struct(*attributes).alias("b"))
    j = a.join(b, keys, "full")
    eq = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    pick = lambda want: F.when(both, F.array_compact(F.array(*[F.when(eq(c) if want else ~eq(c), F.lit(c)) for c in attributes]))).otherwise(F.array().cast("array<string>"))
    j = j.withColumns({"matching": pick(True), "mismatching": pick(False)})
    status = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").when(F.size("mismatching") == 0, "COMMON").otherwise("MODIFIED")
    return j.withColumn("status", status)


def align_annotations(old: list[dict], new: list[dict]) -> list[tuple[str, dict | None, dict | None]]:
    """Annotations of one span: exact pairs first, then each old one with the free new one of most equal attributes
    (at least one; the first of equal ones), else MISSING; what is left of the new is EXTRA."""
    free, out, rest = list(range(len(new))), [], []
    for a in old:
        k = next((k for k in free if new[k] == a), None)
        if k is None:
            rest.append(a)
        else:
            free.remove(k)
            out.append(("COMMON", a, new[k]))
    for a in rest:
        score = {k: sum(new[k].get(x) == v for x, v in a.items()) for k in free}
        k = max(free, key=lambda k: (score[k], -k), default=None)
        if k is None or not score[k]:
            out.append(("MISSING", a, None))
        else:
            free.remove(k)
            out.append(("MODIFIED", a, new[k]))
    out += [("EXTRA", None, new[k]) for k in free]
    assert sum(x[1] is not None for x in out) == len(old) and sum(x[2] is not None for x in out) == len(new)
    return out


def align_layers(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """X5 over tables (keys, ann map<string,string>): (keys, status, a, b), spans matched by a full join; a span holds a few annotations."""
    pack = lambda df, n: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.to_json("ann"))).alias(n))
    j = pack(old, "old").join(pack(new, "new"), keys, "full").select(F.struct(*keys).alias("k"), "old", "new")
    ddl = f"k {j.schema['k'].dataType.simpleString()}, status string, a map<string,string>, b map<string,string>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for n, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                pairs = align_annotations([json.loads(x) for x in a or []], [json.loads(x) for x in b or []])
                rows += [n] * len(pairs)
                found += [(status, x and list(x.items()), y and list(y.items())) for status, x, y in pairs]
            columns = list(zip(*found, strict=True)) or [()] * 3
            values = [pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())).cast(schema[0].type), *values], schema=schema)

    return j.mapInArrow(run, ddl).select("k.*", "status", "a", "b")


def diff_summary(diff: DataFrame, category: str) -> DataFrame:
    """Counts of each status by category, and a TOTAL row if there are several categories."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s.lower()}_spans")
    r = diff.rollup(category).agg(F.grouping(category).alias("__all"), *map(n, ("COMMON", "MODIFIED", "MISSING", "EXTRA")), F.count("*").alias("spans"), F.countDistinct(category).alias("__kinds"))
    name = F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col(category).cast("string")).alias("category")
    return r.where("__all = 0 or __kinds > 1").select(name, "common_spans", "modified_spans", "missing_spans", "extra_spans", "spans")


def render_diff(diff: DataFrame, keys: list[str]) -> DataFrame:
    """One line for each span that differs."""
    at = F.concat_ws(" ", *keys)
    return diff.where("status <> 'COMMON'").select(F.concat(at, F.lit(": "), "status", F.lit(" "), F.coalesce(F.to_json("a"), F.lit("-")), F.lit(" -> "), F.coalesce(F.to_json("b"), F.lit("-"))).alias("value"))


def render_context(diff: DataFrame, words: DataFrame, by: list[str], order: str = "pos", width: int = 8, word: str = "word") -> DataFrame:
    """A line for each differing place (by, order, status, a, b): the words around it, the place's own in brackets, and both sides."""
    marked = words.join(diff.where("status <> 'COMMON'").select(*by, order, "status", "a", "b"), [*by, order], "left")
    shown = marked.withColumn("__w", F.when(F.col("status").isNull(), F.col(word)).otherwise(F.concat(F.lit("["), word, F.lit("]"))))
    shown = context(shown, F.col("status").isNotNull(), width, tuple(by), "__w", order)
    at = F.concat_ws(" ", *by, F.col(order).cast("string"))
    side = lambda c: F.coalesce(F.to_json(c), F.lit("-"))
    return shown.select(*by, order, F.concat(at, F.lit(": "), "context", F.lit(" | "), "status", F.lit(" "), side("a"), F.lit(" -> "), side("b")).alias("value"))


def diff_report(old: DataFrame, new: DataFrame, keys: list[str], attributes: list[str], category: str, words: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole comparison of two layers: spans, aligned annotations, counts by category, concise lines and, given words, lines with context.

    Layers are cut to ``attributes`` first; neither is changed. The last of ``keys`` is the place in its
    sentence or document.
    """
    a, b = (df.select(*keys, *attributes) for df in (old, new))
    packed = [df.select(*keys, F.create_map(*[x for c in attributes for x in (F.lit(c), F.col(c).cast("string"))]).alias("ann")) for df in (a, b)]
    spans = layer_diff(a, b, keys, attributes)
    out = {"spans": spans, "annotations": align_layers(*packed, keys), "summary": diff_summary(spans, category), "lines": render_diff(spans, keys)}
    if words is not None:
        out["context"] = render_context(spans, words, keys[:-1], keys[-1])
    return out
