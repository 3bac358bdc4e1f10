"""Sinks: partitioned clustered tables, JSON lines, staged replacement, per-schema messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import split_parts


def write_clustered(df: DataFrame, path: str, partition: str, cluster: Sequence[str], mode: str = "overwrite", files_per_partition: int = 1) -> None:
    """Day-partitioned table whose files are sorted by the cluster columns.

    A busy day is spread over ``files_per_partition`` tasks by a salt derived from
    the cluster columns, so a day holding a third of the rows is not one task.
    """
    salt = F.pmod(F.hash(*cluster), F.lit(files_per_partition))
    (
        df.repartition(F.col(partition), salt)
        .sortWithinPartitions(partition, *cluster)
        .write.mode(mode).partitionBy(partition).parquet(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def as_messages(df: DataFrame, key: Column, topic: str) -> DataFrame:
    """Rows as (topic, key, value) with the whole row as JSON, the shape a broker sink takes."""
    return df.select(F.lit(topic).alias("topic"), key.cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def broker_options(servers: str, topic: str) -> dict[str, str]:
    """Options of a durable, compressed broker sink."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "5", "kafka.compression.type": "gzip"}


def per_schema_messages(tables: DataFrame, keys: Sequence[str], uid: str, limit: int = 1000) -> DataFrame:
    """One message per schema; schemas above ``limit`` tables go out in several bounded parts."""
    split = split_parts(tables, keys, uid, limit)
    body = [c for c in tables.columns if c not in keys]
    return split.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("table_count"),
        F.sort_array(F.collect_list(F.struct(uid, *[c for c in body if c != uid]))).alias("tables"),
    )


def replace_table(spark: SparkSession, df: DataFrame, path: str, staging: str) -> DataFrame:
    """Write to ``staging``, never over a path being read; the caller repoints to the returned table."""
    df.write.mode("overwrite").parquet(staging)
    return spark.read.parquet(staging)
