"""Queries that run as streams and must agree with their batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from ..sources import sinks
from ..streaming import streams
from . import derived as d
from .registry import query

_AUDIT_EVENT = T.StructType([
    T.StructField("audit_id", T.StringType()), T.StructField("event_time", T.TimestampType()), T.StructField("event_type", T.StringType()),
    T.StructField("user_email", T.StringType()), T.StructField("outcome", T.StringType()),
])


def _audit_lines(spark, root, copies: int = 1, spoil: int | None = None) -> str:
    """The audit log as JSON lines in a folder; optionally every event several times, or every n-th line broken."""
    path = scratch_dir(spark, "audit-topic")
    log = d.audit(spark, root).select("audit_id", F.col("timestamp").cast("timestamp").alias("event_time"), "event_type", "user_email", "outcome")
    if copies > 1:
        log = log.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_n")
    lines = sinks.as_messages(log, F.col("audit_id"), "audit")
    if spoil:
        number = F.substring("key", 3, 20).cast("bigint")
        lines = lines.withColumn("value", F.when(number % spoil == 0, F.substring("value", 1, 20)).otherwise(F.col("value")))
    lines.select("value").write.text(path)
    return path


@query("a13_event_source", d.with_ctes("SELECT event_type, outcome, count(*) AS events FROM cat_audit GROUP BY 1, 2", "cat_audit"))
def a13(spark, root):
    """Sink to JSON messages, source them as a stream from the start, decode."""
    events, _ = streams.decoded(streams.read_json_lines(spark, _audit_lines(spark, root)), _AUDIT_EVENT)
    return streams.drain_to_table(events, "a13").groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("events"))


@query("a15_event_sink", d.with_ctes("SELECT count(*) AS messages, count(DISTINCT audit_id) AS keys FROM cat_audit", "cat_audit"))
def a15(spark, root):
    path = scratch_dir(spark, "messages")
    log = d.audit(spark, root)
    sinks.as_messages(log, F.col("audit_id"), "audit").write.json(path)
    back = spark.read.schema("topic string, key string, value string").json(path)
    return back.agg(F.count(F.from_json("value", "audit_id string")).alias("messages"), F.count_distinct("key").alias("keys"))


@query("k3_audit_dedupe", d.with_ctes("SELECT event_type, count(*) AS events FROM cat_audit GROUP BY 1", "cat_audit"))
def k3(spark, root):
    """Every event arrives twice, each is kept once."""
    events, _ = streams.decoded(streams.read_json_lines(spark, _audit_lines(spark, root, copies=2)), _AUDIT_EVENT)
    once = streams.drain_to_table(streams.deduplicated(events, "audit_id", "40 days"), "k3")
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("k4_dead_letters", "SELECT CASE WHEN event_id % 9 = 0 THEN 'dead' ELSE 'good' END AS state, count(*) AS records FROM events GROUP BY 1")
def k4(spark, root):
    """Broken records are set aside and the stream goes on."""
    lines = streams.read_json_lines(spark, _audit_lines(spark, root, spoil=9))
    good, dead = streams.decoded(lines, _AUDIT_EVENT)
    both = good.select(F.lit("good").alias("state")).unionByName(dead.select(F.lit("dead").alias("state")))
    return streams.drain_to_table(both, "k4").groupBy("state").agg(F.count(F.lit(1)).alias("records"))


_STATUS = ["queued", "running", "completed", "failed", "running"]
_STATUS_OF = dict(zip(("view", "click", "purchase", "error", "signup"), _STATUS))


@query("k6_job_states", f"""SELECT user_id AS job_id, arg_max({d.sql_case("event_type", _STATUS_OF)}, (ts, event_id)) AS status, min(CAST(floor(epoch(ts)) AS BIGINT)) AS started_at, max(CAST(floor(epoch(ts)) AS BIGINT)) AS changed_at, count(*) AS transitions,
    max(CAST(floor(epoch(ts)) AS BIGINT)) - min(CAST(floor(epoch(ts)) AS BIGINT)) AS duration_seconds FROM events GROUP BY 1""")
def k6(spark, root):
    """Latest status per job as a stream in update mode; the newest row per job is the state."""
    schema = d.events(spark, root).schema
    e = streams.read_table_stream(spark, root, "events", schema)
    status = F.try_element_at(F.create_map(*[F.lit(x) for kv in _STATUS_OF.items() for x in kv]), F.col("event_type"))
    runs = e.select(F.col("user_id").alias("job_id"), status.alias("status"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.struct("ts", "event_id").alias("seq"))
    return streams.drain_to_table(streams.job_states(runs), "k6", mode="update", key="job_id")


def _watched(spark, root):
    """The events as a stream of several small files, watched by a listener: (metrics, checkpoint, files)."""
    path, folder, checkpoint = scratch_dir(spark, "k7-topic"), scratch_dir(spark, "k7-metrics"), scratch_dir(spark, "k7")
    schema = d.events(spark, root).schema
    d.events(spark, root).repartition(6).write.parquet(path)
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path).withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", "10 minutes")
    with streams.Metrics(spark, folder) as heard:
        done = streams.run_available(e, lambda batch, _id: batch.write.format("noop").mode("overwrite").save(), checkpoint)
        heard.write(str(done.runId))
    return streams.metrics_table(spark, folder), checkpoint, spark.read.parquet(path).select("_metadata.file_path").distinct().toDF("path")


@query("k7_stream_metrics")
def k7(spark, root):
    """Throughput and lag of every batch of a stream (run-time measurements, hence rows only)."""
    return _watched(spark, root)[0]


@query("k7_stream_totals", "SELECT count(*) AS input_rows, CAST(3 AS BIGINT) AS batches, CAST(6 AS BIGINT) AS files, CAST(0 AS BIGINT) AS files_left, CAST(floor(epoch(max(ts))) AS BIGINT) AS newest_event, true AS delay_known, true AS rates_known FROM events")
def k7_totals(spark, root):
    """What the batches' metrics add up to: all rows and files, nothing left, and the newest event with its delay."""
    metrics, checkpoint, files = _watched(spark, root)
    sums = metrics.filter("input_rows > 0").agg(
        F.sum("input_rows").alias("input_rows"), F.count_distinct("batch_id").alias("batches"), F.unix_seconds(F.max("max_event_time")).alias("newest_event"),
        F.bool_and(F.col("event_delay_seconds") > 0).alias("delay_known"), F.bool_and(F.col("rows_per_second") > 0).alias("rates_known"))
    left = streams.file_backlog(spark, checkpoint, files).agg(F.sum("files").alias("files"), F.min("files_left").alias("files_left"))
    return sums.withColumns({c: left.select(c).scalar() for c in left.columns})


def _closed(window: int, delay: int) -> str:
    b = f"(CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % {window})"
    return f"SELECT event_type, {b} AS bucket, count(*) AS n FROM events GROUP BY 1, 2 HAVING {b} + {window} <= (SELECT epoch(max(ts)) FROM events) - {delay}"


@query("k8_windowed_counts", _closed(3600, 600))
def k8(spark, root):
    """Hourly event-time counts in append mode: closed windows only."""
    schema = d.events(spark, root).schema
    e = streams.read_table_stream(spark, root, "events", schema).withColumn("event_time", F.col("ts").cast("timestamp"))
    return streams.drain_to_table(streams.windowed_counts(e, "1 hour", "10 minutes", ("event_type",)), "k8")


@query("k8_sliding_counts", """
    WITH b AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 1800 AS s FROM events), w AS (SELECT event_type, s AS bucket FROM b UNION ALL SELECT event_type, s - 1800 FROM b)
    SELECT event_type, bucket, count(*) AS n FROM w GROUP BY 1, 2 HAVING bucket + 3600 <= (SELECT epoch(max(ts)) FROM events) - 600""")
def k8_sliding(spark, root):
    schema = d.events(spark, root).schema
    e = streams.read_table_stream(spark, root, "events", schema).withColumn("event_time", F.col("ts").cast("timestamp"))
    return streams.drain_to_table(streams.windowed_counts(e, "1 hour", "10 minutes", ("event_type",), slide="30 minutes"), "k8s")
