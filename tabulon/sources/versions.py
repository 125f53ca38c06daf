"""Table versions written to the folder that the session's driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def version_dir(spark: SparkSession) -> str:
    """Where versions go: the session's spark.checkpoint.dir. A local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or re.match(r"local\[", master)):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="tabulon-versions-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    """Versions are working copies; what outlives the engine is in its data folder."""
    while _made:
        spark, path = _made.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has gone; whoever owns the shared folder clears it
            return


def written_version(df: DataFrame, name: str) -> DataFrame:
    """The rows as files of their own: a short plan, and nothing to recompute."""
    path = f"{version_dir(df.sparkSession)}/version-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
