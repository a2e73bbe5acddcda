"""Sources S1-S14. Every reader has a declared schema and checks the columns it needs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexigrid.functions.text import pick_file
from lexigrid.session import cut

WORD_ROWS = "sentence_id long, words string, form string, pos string, labels string, type string, source string, ord long"
LEXICON = "lemma string, inflect_type string, pos string, case string, form string"
CANDIDATES = "text string, corpus string, doc_id string, forms array<struct<word:string,form:string,start:int,end:int>>"
ANNOTATED = "text string, meta map<string,string>, layers array<struct<name:string,spans:array<struct<start:int,end:int,annotations:array<map<string,string>>>>>>"
TASKS = "data struct<text:string,word:string,start:int,end:int,source:string>, annotations array<struct<result:array<struct<value:struct<start:int,end:int,labels:array<string>,choices:array<string>>>>>>"
RESULTS = "model_name string, set_name string, accuracy double, precision double, recall double, `f1-score` double, _corrupt_record string"
#: Labels that each inflection type may have.
TYPE_LABELS = {1: ("sg n", "sg g"), 16: ("sg n", "sg g"), 17: ("sg n", "sg g", "sg p"), 19: ("sg g", "sg p", "adt")}


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_annotated(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(source, text, meta, span_id, start, end, annotations) of one layer; documents without it are passed over."""
    docs = spark.read.schema(ANNOTATED).json(path, multiLine=True).withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    docs = docs.withColumn("layer", F.try_element_at(F.filter("layers", lambda x: x["name"] == layer), F.lit(1))).where("layer is not null")
    spans = docs.select("source", "text", "meta", F.posexplode("layer.spans").alias("span_id", "span"))
    return spans.select("source", "text", "meta", "span_id", "span.*")


def read_word_rows(spark: SparkSession, path: str, columns: tuple[str, ...] = ("sentence_id", "words", "source")) -> DataFrame:
    """S2."""
    return require_columns(spark.read.parquet(path), list(columns))


def load_table(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """S3: csv or parquet, by the suffix if the format is auto."""
    known = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}
    if fmt == "auto":
        fmt = next((f for suffix, f in known.items() if path.lower().rstrip("/").endswith(suffix)), "")
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format of {path}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


#: Blocks of files whose numbers are broadcast at most.
FEW_BLOCKS = 50_000


def _sentences(batches: Iterator[pa.RecordBatch], schema: pa.Schema, summary: bool) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, value) in the order of their file to token lines placed within their block, or to one row a block.

    What stands before the first blank line may belong to a sentence of the block before and is told by ``head``.
    """
    token, number = re.compile(r"\d+\t").match, re.compile(r"\d").match
    at, rows = None, []
    blank = counted = head_counted = False
    tokens = head_tokens = later = 0

    def close() -> None:
        if summary and at is not None:
            rows.append((*at, blank, head_counted if blank else counted, head_tokens if blank else tokens, later, counted, tokens))

    def given() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != at:
                close()
                at, blank, counted, head_counted, tokens, head_tokens, later = (file, block), False, False, False, 0, 0, 0
            if not line.strip(" \t\r"):
                if not blank:
                    blank, head_counted, head_tokens = True, counted, tokens
                counted, tokens = False, 0
                continue
            if not counted and number(line):
                counted = True
                later += blank
            if token(line):
                if not summary:
                    rows.append((file, block, not blank, max(0, later - 1), tokens, line))
                tokens += 1
        if not summary:
            yield given()
            rows = []
    close()
    if summary:
        yield given()


def _carried(blocks: pd.DataFrame) -> pd.DataFrame:
    """What each block of a file finds begun: one row a block, and no line, is held."""
    out, n, is_open, tokens = [], 0, False, 0
    for r in blocks.sort_values("block").itertuples():
        new = r.head_counted and not is_open
        out.append((r.file, r.block, n - 1 if is_open else n, tokens, n + new))
        n += new + (r.later if r.blank else 0)
        is_open, tokens = (r.counted, r.tokens) if r.blank else (is_open or r.head_counted, tokens + r.head_tokens)
    return pd.DataFrame(out, columns=["file", "block", "head_sentence", "head_tokens", "base"])


PLACED = "file string, block long, head boolean, sentence int, position int, line string"
BLOCKS = "file string, block long, blank boolean, head_counted boolean, head_tokens int, later int, counted boolean, tokens int"


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """One row a token: source, sentence (from 0), position, and the ten columns; feats as text, ``_`` as null.

    Sentences end at blank lines; those without a line that begins with a digit don't count. A file is read in the
    blocks in which Spark splits any text, by as many tasks: each numbers the sentences that begin in its block, and what a
    block holds of a sentence begun before is told apart. A second look at the blocks, one row each, gives every block the
    number of sentences and tokens before it. So a file of any size needs no task to hold it, in any store that Spark reads.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    of_block, of_line = (to_arrow_schema(T.StructType.fromDDL(x)) for x in (BLOCKS, PLACED))
    blocks = lines.mapInArrow(lambda b: _sentences(b, of_block, True), BLOCKS)
    shifts = cut(blocks.groupBy("file").applyInPandas(_carried, "file string, block long, head_sentence int, head_tokens int, base int"))
    placed = lines.mapInArrow(lambda b: _sentences(b, of_line, False), PLACED)
    placed = placed.join(F.broadcast(shifts) if shifts.count() <= FEW_BLOCKS else shifts, ["file", "block"])
    names = ("id", "text", "lemma", "upostag", "xpostag", "feats", "head", "deprel", "deps", "misc")
    cells = F.split("line", "\t")
    null = lambda k, n: F.get(cells, F.lit(k)) if n in ("text", "lemma", "id") else F.nullif(F.get(cells, F.lit(k)), F.lit("_"))
    sentence = F.when(F.col("head"), F.col("head_sentence")).otherwise(F.col("base") + F.col("sentence"))
    position = F.col("position") + F.when(F.col("head"), F.col("head_tokens")).otherwise(0)
    source = F.regexp_extract("file", r"([^/]+)$", 1)
    return placed.select(source.alias("source"), sentence.alias("sentence"), position.alias("position"), *[null(k, n).alias(n) for k, n in enumerate(names)])


def read_json_lines(spark: SparkSession, path: str, schema: str = CANDIDATES) -> DataFrame:
    """One object a line; blank lines are passed over. sentence_no counts the others from 0 in each file."""
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select("value", file, block).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    # rows of a block are numbered one after another; a block begins where those before it in its file end
    sizes = lines.groupBy("file", "block").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("shift"))
    numbered = lines.join(shifts, ["file", "block"])
    return numbered.select("file", (F.col("at") + F.col("shift")).alias("sentence_no"), F.from_json("value", schema).alias("x")).select("file", "sentence_no", "x.*")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The forms lexicon; empty cells stay empty text; the header must be the declared one. Type ``19|2`` counts as 19."""
    raw = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    names = [f.split()[0] for f in LEXICON.split(", ")]
    if raw.columns != names:
        raise ValueError(f"header {raw.columns} is not {names}")
    return raw.na.fill("").withColumn("inflect_type", F.split_part("inflect_type", F.lit("|"), F.lit(1)))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Sentences with their target span and first label, null if there is none; labels outside the type's set are an error."""
    raw = spark.read.schema(TASKS).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    kind = F.regexp_extract("file", r"(?:^|/)[^/_]*_[^/_]*_(\d+)[^/]*$", 1).try_cast("int")
    value = F.try_element_at(F.try_element_at(F.col("annotations.result"), F.lit(1)), F.lit(1))["value"]
    label = F.coalesce(F.try_element_at(value["labels"], F.lit(1)), F.try_element_at(value["choices"], F.lit(1)))
    out = raw.select("file", kind.alias("inflection_type"), "data.*", label.alias("label"))
    allowed = F.create_map(*[x for k, v in TYPE_LABELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wrong = F.col("label").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(allowed, "inflection_type"), F.col("label")), F.lit(True))
    return out.withColumn("label", F.when(wrong, F.raise_error(F.concat(F.lit("label not allowed: "), "label"))).otherwise(F.col("label")))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-cased words; blank lines are dropped."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a JSON list. The file is what is returned, unlike a loader that regenerates it."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("id", "label"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, batch, inflection_type): one level down; the type is the third part of the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path")
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("batch")).withColumn("inflection_type", F.split_part(F.split_part("name", F.lit("."), F.lit(1)), F.lit("_"), F.lit(3)))


def list_picks(spark: SparkSession, path: str) -> DataFrame:
    """Earlier pick files with their type, size and pick number."""
    return list_files(spark, path, "*.jl").select("path", "name", pick_file(F.col("name")).alias("x")).where("x is not null").select("path", "name", "x.*")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records. A missing file gives no rows; one that is no list of records is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], RESULTS).drop("_corrupt_record")
    whole = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    if whole.where(~F.trim("value").startswith("[")).head(1):
        raise ValueError(f"{path} is not a JSON list; it is left as it is")
    return spark.read.schema(RESULTS).option("mode", "FAILFAST").json(path, multiLine=True).drop("_corrupt_record")


def find_missing_xpos(spark: SparkSession, path: str) -> DataFrame:
    """Treebank lines whose fifth column is empty."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike(r"^\d+\t[^\t]*\t[^\t]*\t[^\t]*\t_\t"))
