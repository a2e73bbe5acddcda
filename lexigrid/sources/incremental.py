"""K3, K4: files that are processed once each, with rows that fail counted and kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new_files(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], error: Column, target: str, checkpoint: str, fmt: str = "json") -> dict[str, int]:
    """Takes the files of ``source`` that no earlier run with this checkpoint has taken, and adds their rows to ``target``.

    ``work`` makes result rows of source rows, ``error`` tells over the result why a row failed (null if it didn't). A failed
    row is written with its reason in column ``error`` and counted, not lost, and does not stop the others. The files taken
    and the files written are both logged with the checkpoint, so a run that is broken off and begun again writes each row
    once. Returns the numbers of rows and of errors of this run; 0 of both if there was nothing new. A folder
    without files is no error; a source line that is no object has null columns.
    """
    name = f"counts_{uuid.uuid4().hex}"
    rows = work(spark.readStream.schema(schema).format(fmt).load(source)).withColumn("error", error)
    counted = rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    query = counted.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p.observedMetrics[name] for p in query.recentProgress if name in p.observedMetrics]
    return {k: sum(r[k] for r in seen) for k in ("rows", "errors")}


def processed(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows that went well, rows that failed with their reason) of all runs: only files of finished runs are read."""
    rows = spark.read.parquet(target)
    return rows.where("error is null").drop("error"), rows.where("error is not null")
