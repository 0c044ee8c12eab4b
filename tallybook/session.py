"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Session settings the wide cleaning stages profit from; `tune` sets them on a running session. The JVM
# never compiles a method of more than 8,000 bytes, so a fused stage beyond that would be
# interpreted; below the limit Spark runs it as separate, compiled operators.
# Shuffled sales lines take up about ten times as much memory as bytes, so partitions are kept small: 8 MB, of up
# to 1,024, and a task's memory does not follow the table. Small shuffles are still gathered in few partitions.
TUNING = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "tallybook", memory: str = "16g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` of the session.

    Only a session on one machine (tests, the bench) may leave it unset: its executors see the driver's
    disk, so a fresh local folder is as good. On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="run-tallybook-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a fresh table in the shared folder and read them from there.

    They survive lost executors and the plan starts afresh. Unlike after `checkpoint()` the planner
    knows the true size of the table, so joins and loops that build on it stay well planned.
    """
    path = fresh_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
