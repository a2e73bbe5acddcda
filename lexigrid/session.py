"""Sessions and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexigrid", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the session is made by spark-submit and only the SQL settings matter."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lexigrid-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"


#: Whether the files of an action's shuffles go when it ends, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files behind."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; the shuffles that led there are let go."""
    shared_folder(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def keep(df: DataFrame, path: str) -> DataFrame:
    """Materialise as compressed columns under ``path``, behind what is there; ``delete`` removes it before the session ends."""
    with released(df.sparkSession):
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
