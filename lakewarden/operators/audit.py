"""Audit log: idempotent append, queries, compliance reports, vocabulary enforcement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.rows import first_per_key

AUDIT_SCHEMA = (
    "audit_id string, timestamp timestamp_ntz, event_type string, user_id string, user_email string, user_role string, "
    "source_ip string, service string, resource_type string, resource_id string, resource_fqn string, action string, "
    "outcome string, request_id string, session_id string, changes string, metadata string"
)
AUDIT_FIELDS = tuple(part.strip().split(" ")[0] for part in AUDIT_SCHEMA.split(","))


def new_events(existing: DataFrame, batch: DataFrame, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Rows of a batch not stored yet: the first copy of each audit_id, never an update.

    A third of the batch may be copies of one id: picking the first is a partial
    aggregate, so copies collapse before the shuffle.
    """
    return first_per_key(batch, ["audit_id"], list(order)).join(existing.select("audit_id"), "audit_id", "left_anti")


def query(
    log: DataFrame, user_email: str | None = None, event_type: str | None = None, resource_fqn: str | None = None,
    start: str | None = None, end: str | None = None, limit: int = 100, fqn_match: str = "exact",
) -> DataFrame:
    """Newest events first, both time bounds inclusive, 1 to 1000 rows (a bounded top-k, not a global sort)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    if user_email:
        log = log.filter(F.col("user_email") == user_email)
    if event_type:
        log = log.filter(F.col("event_type") == event_type)
    if resource_fqn:
        fqn = F.col("resource_fqn")
        log = log.filter(fqn == resource_fqn if fqn_match == "exact" else fqn.contains(resource_fqn))
    if start:
        log = log.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        log = log.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    return log.orderBy(F.col("timestamp").desc(), "audit_id").limit(limit)


def within_days(log: DataFrame, as_of: str, days: int, time_col: str = "timestamp") -> DataFrame:
    edge = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return log.filter((F.col(time_col) >= edge) & (F.col(time_col) < F.lit(as_of).cast("timestamp_ntz")))


def pii_access_report(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Personal-data reads of the last ``days`` days per user, complete (no row limit)."""
    recent = within_days(log.filter(F.col("event_type") == "PII_ACCESS"), as_of, days)
    return recent.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("access_count"), F.count_distinct("resource_fqn").alias("distinct_resources"),
        F.min("timestamp").alias("first_access"), F.max("timestamp").alias("last_access"),
    )


def on_day(log: DataFrame, day: str) -> DataFrame:
    """One day's activity as a range on the stored column, so files and partitions are pruned."""
    start = F.lit(day).cast("timestamp_ntz")
    return log.filter((F.col("timestamp") >= start) & (F.col("timestamp") < start + F.expr("INTERVAL 1 DAY")))


def count_by(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))


def valid_and_quarantined(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason). The vocabularies are literals: a projection, no join."""
    reason = F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(*vocab.AUDIT_EVENT_TYPES), "event_type").when(
        F.col("outcome").isNull() | ~F.col("outcome").isin(*vocab.AUDIT_OUTCOMES), "outcome"
    )
    marked = log.withColumn("reject_reason", reason)
    return marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"), marked.filter(F.col("reject_reason").isNotNull())


def payload_value(df: DataFrame, column: str, path: str, type_name: str, alias: str) -> DataFrame:
    """Typed value out of a JSON payload; malformed payloads give NULL."""
    return df.withColumn(alias, F.try_variant_get(F.try_parse_json(column), path, type_name))


def normalise(frames: dict[str, DataFrame]) -> DataFrame:
    """Emitters of several services as one log: service name filled in, ``details`` kept as metadata, defaults set."""
    types = {p.strip().split(" ")[0]: p.strip().split(" ")[1] for p in AUDIT_SCHEMA.split(",")}
    out = []
    for service, df in frames.items():
        if "details" in df.columns and "metadata" not in df.columns:
            df = df.withColumnRenamed("details", "metadata")
        df = df.withColumn("service", F.coalesce(F.col("service"), F.lit(service)) if "service" in df.columns else F.lit(service))
        df = df.withColumn("outcome", F.coalesce(F.col("outcome"), F.lit("SUCCESS")) if "outcome" in df.columns else F.lit("SUCCESS"))
        out.append(df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in AUDIT_FIELDS]))
    return reduce(DataFrame.unionByName, out)
