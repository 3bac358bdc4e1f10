"""Session settings and shared scratch space."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lakewarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partitions are left to AQE: start high, coalesce down at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # operators build hundreds of expressions; recording a call site for each is slow
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are compared and printed in UTC, whatever the caller's session says."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only on one machine (tests) a local folder is made where none is named; on a cluster that is an error,
    as executors would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lakewarden-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared root for staged tables and stream checkpoints."""
    return f"{_shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike executor-local blocks."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_root(spark))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Written once to the shared folder and read by all that follows, each of which reads only the fields it needs.

    Files keep a repeated value once where a checkpoint or a shuffle writes every row in full. The shuffle files of the writing
    job go when it ends, as the table holds what they held.
    """
    folder = scratch_dir(df.sparkSession, purpose)
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
