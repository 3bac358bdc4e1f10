"""Service-level and security alerts over event tables.

Raw events are reduced to (series, time bucket) counts first, with map-side
combine; everything after that works on the bucket grid, whose size depends on
the time span and not on the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import bucket_start


def bucketed(events: DataFrame, seconds: int, keys: Sequence[str] = (), time_col: str = "ts", measures: dict[str, Column] | None = None) -> DataFrame:
    """Counts (and further measures) per series and tumbling bucket; ``bucket`` is its start in epoch seconds."""
    return events.groupBy(*keys, bucket_start(time_col, seconds).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), *[expr.alias(name) for name, expr in (measures or {}).items()]
    )


def rates(events: DataFrame, seconds: int, keys: Sequence[str] = (), time_col: str = "ts") -> DataFrame:
    """Events per second by series and window."""
    return bucketed(events, seconds, keys, time_col).withColumn("rate", F.col("n") / F.lit(float(seconds)))


def counter_increase(samples: DataFrame, keys: Sequence[str], seconds: int, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Increase of a cumulative counter per window, counting a drop as a restart from zero.

    The predecessor of a sample is looked up inside its own bucket; across buckets only
    the first and last sample of each bucket matter, so the window over a series runs
    over one row per bucket, not over all samples of a busy series.
    """
    b = samples.withColumn("bucket", bucket_start(order[0], seconds))
    inner = Window.partitionBy(*keys, "bucket").orderBy(*order)
    prev = F.lag("value").over(inner)
    steps = b.withColumn("_d", F.when(prev.isNull(), 0).when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev))
    stamp = F.struct(*order)
    per = steps.groupBy(*keys, "bucket").agg(
        F.sum("_d").alias("_inside"), F.min_by("value", stamp).alias("_first"), F.max_by("value", stamp).alias("_last")
    )
    outer = Window.partitionBy(*keys).orderBy("bucket")
    before = F.lag("_last").over(outer)
    edge = F.when(before.isNull(), 0).when(F.col("_first") < before, F.col("_first")).otherwise(F.col("_first") - before)
    return per.withColumn("increase", F.col("_inside") + edge).select(*keys, "bucket", "increase")


def error_ratio(events: DataFrame, is_error: Column, seconds: int = 300, keys: Sequence[str] = (), time_col: str = "ts") -> DataFrame:
    """Share of failing events per series and window."""
    out = bucketed(events, seconds, keys, time_col, {"errors": F.count_if(is_error)})
    return out.withColumn("ratio", F.col("errors") / F.col("n"))


def histogram_quantile(events: DataFrame, value: str, q: float, seconds: int, keys: Sequence[str] = (), bounds: Sequence[float] = vocab.DURATION_BUCKETS, time_col: str = "ts") -> DataFrame:
    """Quantile estimated from bucket counts with linear interpolation inside the bucket.

    Values above the last bound give the last bound. All bucket counts of a window are
    one row of conditional counts, so the interpolation is a plain expression.
    """
    measures = {f"le_{i}": F.count_if(F.col(value) <= b) for i, b in enumerate(bounds)}
    grid = bucketed(events, seconds, keys, time_col, measures)
    target = F.lit(q) * F.col("n")
    expr = None
    for i, bound in enumerate(bounds):
        low = F.lit(float(bounds[i - 1])) if i else F.lit(0.0)
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        inside = F.col(f"le_{i}") - below
        point = low + (F.lit(float(bound)) - low) * ((target - below) / inside)
        test = F.col(f"le_{i}") >= target
        expr = F.when(test, point) if expr is None else expr.when(test, point)
    return grid.withColumn("quantile", expr.otherwise(F.lit(float(bounds[-1])))).select(*keys, "bucket", "n", "quantile")


def sliding_ratio(events: DataFrame, is_error: Column, window_seconds: int, step_seconds: int, keys: Sequence[str] = (), time_col: str = "ts") -> DataFrame:
    """Error ratio over sliding windows, at every step whose window holds an event.

    Each step's counts go to the evaluations that look back on it, at most window / step of them, and are
    summed there with map-side combine: idle steps are evaluated as well, and no series runs through one task.
    ``at`` is the end of the evaluated window.
    """
    if window_seconds % step_seconds:
        raise ValueError("the window must be a multiple of the step")
    per_step = bucketed(events, step_seconds, keys, time_col, {"errors": F.count_if(is_error)})
    at = F.explode(F.sequence(F.col("bucket") + step_seconds, F.col("bucket") + window_seconds, F.lit(step_seconds).cast("bigint")))
    seen = per_step.select(*keys, at.alias("at"), "errors", "n").groupBy(*keys, "at").agg(F.sum("errors").alias("errors"), F.sum("n").alias("total"))
    return seen.withColumn("ratio", F.col("errors") / F.col("total"))


BLOCK_STEPS = 4096


def firing(grid: DataFrame, keys: Sequence[str], at: str, condition: Column, step_seconds: int, hold_seconds: int, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Alert episodes: maximal runs of consecutive evaluations where ``condition`` holds, kept when they last ``hold_seconds``.

    ``grid`` has at most one row per series and step; a missing step ends a run.
    Runs are found inside blocks of ``block_steps`` steps, where consecutive points share (time - rank * step), so a long series
    is dealt over as many tasks as it has blocks. Runs that reach the border of a block, at most two per block, are then
    joined with their neighbours.
    """
    series, step, span = list(keys) or ["_series"], F.lit(step_seconds), F.lit(step_seconds * block_steps)
    points = grid.withColumn("_series", F.lit(0)).filter(F.coalesce(condition, F.lit(False))).withColumn("_block", F.floor(F.col(at) / span))
    rank = F.row_number().over(Window.partitionBy(*series, "_block").orderBy(at))
    inside = points.withColumn("_run", F.col(at) - rank * step).groupBy(*series, "_block", "_run").agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("points"))
    border = (F.col("started_at") - step < F.col("_block") * span) | (F.col("ended_at") + step >= (F.col("_block") + 1) * span)
    whole = inside.filter(~border).select(*series, "started_at", "ended_at", "points")
    order = Window.partitionBy(*series).orderBy("started_at")
    first = F.coalesce(F.lag("ended_at").over(order) + step != F.col("started_at"), F.lit(True))
    joined = inside.filter(border).withColumn("_first", first.cast("int")).withColumn("_run", F.sum("_first").over(order))
    long = joined.groupBy(*series, "_run").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("points").alias("points")).drop("_run")
    lasting = F.col("ended_at") - F.col("started_at") >= hold_seconds
    return whole.unionByName(long).filter(lasting).withColumn("fires_at", F.col("started_at") + hold_seconds).select(*keys, "started_at", "ended_at", "points", "fires_at")


def time_grid(spark, start: int, stop: int, step: int) -> DataFrame:
    return spark.range(start, stop, step).withColumnRenamed("id", "bucket")


def silent_windows(events: DataFrame, keys: Sequence[str], seconds: int, start: int, stop: int, time_col: str = "ts") -> DataFrame:
    """Windows of [start, stop) in which a known series has no event.

    Every series gets its own dense grid from ``sequence``; no product of tables.
    """
    counts = bucketed(events, seconds, keys, time_col).select(*keys, "bucket", "n")
    dense = counts.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(stop - seconds).cast("bigint"), F.lit(seconds).cast("bigint"))).alias("bucket")
    )
    return dense.join(counts, [*keys, "bucket"], "left_anti")


def availability(events: DataFrame, is_error: Column, key: Column | None = None) -> DataFrame:
    """Percentage of events that did not fail, over all events or per ``key`` (e.g. per day)."""
    agg = (F.count(F.lit(1)).alias("total"), F.count_if(is_error).alias("errors"))
    out = events.groupBy(key).agg(*agg) if key is not None else events.agg(*agg)
    return out.withColumn("availability_pct", F.round(100.0 * (1 - F.col("errors") / F.col("total")), 6))


def stuck_jobs(starts: DataFrame, finishes: DataFrame, as_of: int, limit_seconds: int = 3600) -> DataFrame:
    """Jobs started more than ``limit_seconds`` before ``as_of`` without a finish. Columns: job_id, started_at (epoch)."""
    open_jobs = starts.filter(F.col("started_at") < as_of - limit_seconds).join(finishes.select("job_id"), "job_id", "left_anti")
    return open_jobs.withColumn("running_seconds", F.lit(as_of) - F.col("started_at"))


def latest_gauges(samples: DataFrame, keys: Sequence[str], time_cols: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Newest value per series, a partial aggregate."""
    return samples.groupBy(*keys).agg(F.max_by("value", F.struct(*time_cols)).alias("value"), F.max(time_cols[0]).alias("sampled_at"))


def gauge_alerts(latest: DataFrame, metric_col: str, thresholds: dict[str, float]) -> DataFrame:
    """Series whose newest value exceeds its metric's threshold (a literal map, not a join)."""
    pairs = [F.lit(x) for kv in thresholds.items() for x in kv]
    limit = F.try_element_at(F.create_map(*pairs), F.col(metric_col))
    return latest.withColumn("threshold", limit).filter(F.col("value") > F.col("threshold"))


def failure_alerts(events: DataFrame, is_failure: Column, keys: Sequence[str], seconds: int = 900, share: float = 0.2) -> DataFrame:
    return error_ratio(events, is_failure, seconds, keys).filter(F.col("ratio") > share)


def spikes(events: DataFrame, keys: Sequence[str], seconds: int, min_count: int) -> DataFrame:
    """Windows in which a series exceeds ``min_count`` events."""
    return bucketed(events, seconds, keys).filter(F.col("n") > min_count)


def grouped_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts after inhibition (a critical one silences warnings of the same name and service), grouped for notification."""
    same = ["alertname", "service"]
    critical = alerts.filter(F.col("severity") == "critical").select(*same).distinct()
    warnings = alerts.filter(F.col("severity") == "warning").join(critical, same, "left_anti")
    rest = alerts.filter(F.col("severity") != "warning")
    return rest.unionByName(warnings).groupBy(*same, "severity").agg(F.count(F.lit(1)).alias("alert_count"), F.min("started_at").alias("first_at"))
