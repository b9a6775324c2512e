"""Tables between the steps of a long job, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folder of each application on a local master that names none; spark.checkpoint.dir can't be set in a running one.
_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names.

    An application on a local master that names none gets a temporary one of its own; elsewhere its absence is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="lodestack-")
        shared = _local[context.applicationId]
    return f"{shared.rstrip('/')}/lodestack/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor loses nothing.

    codec: another compression than the session's, for rows that repeat much of each other.

    Shuffle files behind the written table serve nobody any more, so Spark is told to drop them as the write ends.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by cut, once what was read from them is written; a DataFrame over them can't be read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """df, marked for a broadcast if its files have at most `limit` bytes; beyond that Spark joins it by a shuffle.

    df reads a table that is written, so that its size is known without a job.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df
