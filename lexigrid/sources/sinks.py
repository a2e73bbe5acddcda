"""Sinks K1-K13, all written by executors but for scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions.text import span_matches
from lexigrid.sources.readers import read_results


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """K1: replaces what is there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header in each file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_new_sources(df: DataFrame, path: str, source_col: str = "source") -> None:
    """K3: appends one folder for each source; sources that are there already are skipped."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where) and fs.listStatus(where):
        df = df.join(spark.read.option("header", True).csv(path).select(F.col(source_col).cast("string")).distinct(), source_col, "left_anti")
    df.write.mode("append").option("header", True).partitionBy(source_col).csv(path)


def reannotate(df: DataFrame, scorer, schema: str, path: str, id_col: str | None = None, existing: str = "replace", lengths: tuple[str, ...] = ("n_words", "n_labels"), error: Column | None = None) -> dict[str, int]:
    """K4: documents through a scorer (an iterator of frames to an iterator of frames) to JSON; (rows, errors) written.

    The columns ``lengths``, where there are all of them, must be equal in a row, else it is an error. ``existing`` is what
    becomes of what ``path`` holds: ``replace`` writes all anew, ``skip`` passes over documents whose ``id_col`` stands there
    and adds the others, ``fail`` raises. Rows of which ``error`` (a column over the result) is not null are counted and
    written with it.
    """
    if existing not in ("replace", "skip", "fail"):
        raise ValueError(existing)
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.exists(where) and len(fs.listStatus(where)) > 0
    if held and existing == "fail":
        raise FileExistsError(path)
    if existing == "skip":
        if id_col is None:
            raise ValueError("skip needs id_col")
        if held:
            df = df.join(spark.read.schema(schema).json(path).select(id_col).distinct(), id_col, "left_anti").select(*df.columns)
    out = df.mapInPandas(scorer, schema)
    if set(lengths) <= set(out.columns):
        first, *others = lengths
        for c in others:
            out = out.withColumn(c, F.when(F.col(first) == F.col(c), F.col(c)).otherwise(F.raise_error(F.lit("layers differ in length")).cast(out.schema[c].dataType)))
    out = out.withColumn("error", error) if error is not None else out
    seen = Observation()
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"), (F.count_if(F.col("error").isNotNull()) if error is not None else F.lit(0).cast("long") + F.count_if(F.lit(False))).alias("errors"))
    out.write.mode("append" if existing == "skip" else "overwrite").json(path)
    return dict(seen.get)


def label_tasks(df: DataFrame, labels: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """K5: (one task a row as JSON, the interface text). The span's text must be the word. Columns ``keep`` stand in the task too."""
    ok = F.when(span_matches(F.col("text"), F.col("start"), F.col("end"), F.col("word")), F.col("word")).otherwise(F.raise_error(F.concat(F.lit("span is not the word: "), "word")))
    tasks = df.withColumn("word", ok).select(F.to_json(F.struct(F.struct("text", "word", "start", "end", *keep).alias("data"))).alias("value"))
    view = "<View><Labels name='label' toName='text'>" + "".join(f"<Label value='{x}'/>" for x in labels) + "</Labels><Text name='text' value='$text'/></View>"
    return tasks, view


def write_json_lines(df: DataFrame, path: str) -> None:
    """K6, K9."""
    df.write.mode("overwrite").json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Records of ``new`` replace those of ``old`` with the same key; of new ones with equal keys any stays, by text order."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    text = F.to_json(F.struct(*[c for c in both.columns if c != "__new"]))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), text))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__new", "__rank")


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Renames one file over another in one step of the file system, so that the target is never missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    kind = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    files = hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(old, new, options)


def write_cost(spark: SparkSession, path: str, cost: float) -> None:
    """The running cost, one number in a file that is replaced in one step."""
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = tmp.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp)
    out.write(bytearray(repr(float(cost)).encode()))
    out.hsync()
    out.close()
    replace_file(spark, f"{tmp}", path)


def read_cost(spark: SparkSession, path: str) -> float:
    """The running cost, 0 if none was written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0.0
    return float(spark.read.text(path).first()[0])


def upsert_results(spark: SparkSession, path: str, new: DataFrame, keys: tuple[str, ...] = ("model_name", "set_name")) -> None:
    """K7: the JSON array at ``path`` with new records put in; written beside it, then renamed over it in one step."""
    rows = upsert(read_results(spark, path), new, list(keys)).orderBy(*keys)
    text = rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("value"))  # a registry of models, not data
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    tmp, target = fs_path(f"{path}.{uuid.uuid4().hex}"), fs_path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp)
    out.write(bytearray(text.first()["value"].encode()))
    out.hsync()
    out.close()
    replace_file(spark, f"{tmp}", path)


def sampling_report(rows: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """One row of totals and parameters. Flagged duplicates count."""
    totals = rows.agg(F.count("*").alias("words"), F.countDistinct("orig_corpus", "source", "sentence_id").alias("sentences"), F.sum(F.col("duplicated_sentence").cast("long")).alias("duplicated_words"))
    return totals.select("*", *[F.lit(v).alias(k) for k, v in parameters.items()])


def write_text(lines: DataFrame, path: str) -> None:
    """One text column."""
    lines.write.mode("overwrite").text(path)
