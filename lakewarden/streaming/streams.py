"""Structured Streaming: the batch operators over event streams.

Broker topics and file folders deliver the same records; the transformations do
not know which. Sinks are idempotent, so at-least-once delivery with a checkpoint
gives each event one effect.
"""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.rows import latest_per_key
from ..session import scratch_dir

# Fixed value: events taken per trigger, the bound of the in-flight queue.
MAX_IN_FLIGHT = 200


def read_topic(spark: SparkSession, servers: str, topic: str, max_offsets: int = 100_000) -> DataFrame:
    """Broker topic from its beginning, values as text (needs the broker package on the cluster)."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", max_offsets).load()
    )
    return raw.select(F.col("value").cast("string").alias("value"))


def read_json_lines(spark: SparkSession, path: str, max_files: int = MAX_IN_FLIGHT) -> DataFrame:
    """Folder of JSON-lines files as a stream of texts, a bounded number of files per trigger."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def read_table_stream(spark: SparkSession, root: str, name: str, schema: T.StructType, max_files: int = MAX_IN_FLIGHT) -> DataFrame:
    """A lake table as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", max_files).parquet(root)


def decoded(texts: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters): unreadable records are kept aside and never stop the stream."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = texts.withColumn("_e", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_e").isNull() | F.col("_e._corrupt").isNotNull() | F.col(f"_e.{schema.fields[0].name}").isNull()
    return parsed.filter(~bad).select("_e.*").drop("_corrupt"), parsed.filter(bad).select("value")


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Processes what is there and stops; the checkpoint is the commit log."""
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_to_table(stream: DataFrame, purpose: str, mode: str = "append", key: str | None = None) -> DataFrame:
    """Runs a stream to its end into a folder and returns the table.

    Every batch goes to its own sub-folder with overwrite, so a retried batch replaces
    itself. In update mode only the newest row per ``key`` (batch order) is returned.
    """
    spark = stream.sparkSession
    root = scratch_dir(spark, purpose)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch_id={batch_id}")

    run_available(stream, write, f"{root}/checkpoint", mode)
    table = spark.read.option("basePath", f"{root}/table").schema(stream.schema.add("batch_id", T.LongType())).parquet(f"{root}/table")
    if key is None:
        return table.drop("batch_id")
    return latest_per_key(table, [key], ["batch_id"]).drop("batch_id")


def windowed_counts(events: DataFrame, window: str, delay: str, keys: tuple[str, ...] = (), slide: str | None = None, time_col: str = "event_time") -> DataFrame:
    """Counts per event-time window; late rows are accepted for ``delay``, then state is dropped."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    out = events.withWatermark(time_col, delay).groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("w.start").alias("bucket"), *keys, "n")


def deduplicated(events: DataFrame, key: str, delay: str, time_col: str = "event_time") -> DataFrame:
    """First arrival of each key; state is bounded by the watermark."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def job_states(run_events: DataFrame, key: str = "job_id") -> DataFrame:
    """Latest status of every job from its run events (batch, or stream in update mode)."""
    stamp = F.struct("at", "seq")
    return run_events.groupBy(key).agg(
        F.max_by("status", stamp).alias("status"), F.min("at").alias("started_at"), F.max("at").alias("changed_at"), F.count(F.lit(1)).alias("transitions")
    ).withColumn("duration_seconds", F.col("changed_at") - F.col("started_at"))


METRICS = (
    "query string, run string, batch_id bigint, ended_at timestamp, input_rows bigint, input_rows_per_second double, rows_per_second double, batch_seconds double, source string, "
    "start_offset string, end_offset string, latest_offset string, offset_lag bigint, max_event_time timestamp, watermark timestamp, event_delay_seconds double, state_rows bigint"
)


def offset_lag(end: str | None, latest: str | None) -> int | None:
    """Records between two offsets of a source as JSON: numbers, or numbers nested by topic and partition; None where a source tells none."""
    if not end or not latest:
        return None

    def behind(a, b) -> int:
        if isinstance(b, dict):
            return sum(behind(a.get(k, 0) if isinstance(a, dict) else 0, v) for k, v in b.items())
        return max(0, int(b) - int(a or 0))

    try:
        return behind(json.loads(end), json.loads(latest))
    except (TypeError, ValueError):
        return None


def metric_rows(progress) -> list[tuple]:
    """One row per source of a batch, in the order of ``METRICS``."""
    when = lambda text: None if not text else datetime.fromisoformat(text.replace("Z", "+00:00"))
    times = progress.eventTime or {}
    ended, newest = when(progress.timestamp), when(times.get("max"))
    seconds = (progress.durationMs or {}).get("triggerExecution", 0) / 1000
    finite = lambda x: None if x is None or not math.isfinite(x) else float(x)
    return [
        (progress.name or str(progress.id), str(progress.runId), progress.batchId, ended, s.numInputRows, finite(s.inputRowsPerSecond), finite(s.processedRowsPerSecond), seconds, s.description, s.startOffset, s.endOffset, s.latestOffset,
         offset_lag(s.endOffset, s.latestOffset), newest, when(times.get("watermark")), (ended - newest).total_seconds() if newest else None, sum(o.numRowsTotal for o in progress.stateOperators))
        for s in progress.sources
    ]


class Metrics(StreamingQueryListener):
    """Keeps one row per source and batch of every stream of the session, written to ``folder`` when asked.

    Progress arrives after a batch, on a thread of its own, for any kind of writer; what a repeated batch reports replaces its row.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._rows: list[tuple] = []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def __enter__(self) -> Metrics:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self._change:
            self._rows += metric_rows(event.progress)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def write(self, run: str, seconds: float = 30) -> str:
        """Waits for the end of a run to be told, then writes what was heard since the last time as one file; returns the folder."""
        with self._change:
            self._change.wait_for(lambda: run in self._ended, seconds)
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(self.folder)
        return self.folder


def metrics_table(spark: SparkSession, folder: str) -> DataFrame:
    """Throughput and lag of every batch so far, the last word on each."""
    return latest_per_key(spark.read.schema(METRICS).parquet(folder), ["query", "batch_id", "source"], ["ended_at"])


def file_backlog(spark: SparkSession, checkpoint: str, files: DataFrame) -> DataFrame:
    """batch_id, files, files_left: what a file stream took in each batch and how much of ``files`` (path) it had still to read.

    Read from the log of the source in the stream's checkpoint: a line per file with the batch that took it.
    """
    plain = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), r"^(\w+):/+", "$1:/")
    lines = spark.read.text(f"{checkpoint}/sources/0").filter(F.col("value").startswith("{"))
    taken = lines.select(F.from_json("value", "path string, batchId bigint").alias("e")).select(plain(F.col("e.path")).alias("path"), F.col("e.batchId").alias("batch_id")).distinct()
    there = files.select(plain(F.col("path")).alias("path")).distinct()
    total = there.agg(F.count(F.lit(1)).alias("n"))
    per_batch = taken.join(there, "path", "left_semi").groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"))
    before = F.sum("files").over(Window.orderBy("batch_id"))  # one row per batch
    return per_batch.withColumn("files_left", total.scalar() - before)


def lag_gauges(metrics: DataFrame) -> DataFrame:
    """The newest figures of every stream as gauges (metric, series, ts, value), for threshold and absence alerts."""
    newest = latest_per_key(metrics, ["query", "source"], ["batch_id"])
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("offset_lag", "event_delay_seconds", "rows_per_second", "state_rows")])
    return newest.select(F.col("query").alias("series"), F.col("ended_at").alias("ts"), F.inline(entries)).filter("value IS NOT NULL")
