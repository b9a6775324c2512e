"""Session set-up shared by all jobs."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if it is not installed, and get small batches.

    Rows are whole texts here: ten thousand of them, Spark's usual batch, are too many for a worker's share of memory.
    A number that the application was started with stays, as does any but the usual one.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, "1000")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))
    return spark


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it: UTC, AQE, few shuffle partitions."""
    conf = {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return reachable(SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate())
