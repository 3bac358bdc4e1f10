"""Queries over the audit log, access policy, alerts and declared transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import epoch_seconds
from ..operators import access, alerts, audit, catalog, transforms
from . import derived as d
from .registry import query



# ---- H: audit --------------------------------------------------------------
def _copies(log):
    """A batch with re-sent events: every event once more with a later timestamp."""
    again = log.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).withColumn("outcome", F.lit("FAILURE"))
    return log.unionByName(again)


@query("h1_idempotent_append", d.with_ctes("SELECT outcome, count(*) AS appended, strftime(max(\"timestamp\"), '%Y-%m-%d %H:%M:%S') AS newest FROM cat_audit WHERE \"timestamp\" >= TIMESTAMP '2024-01-10' GROUP BY 1", "cat_audit"))
def h1(spark, root):
    """Stored: the first nine days. Batch: the whole log twice. Appended: each unseen id once, its first copy."""
    log = d.audit(spark, root)
    stored = log.filter(F.col("timestamp") < F.lit("2024-01-10").cast("timestamp_ntz"))
    new = audit.new_events(stored, _copies(log).select("audit_id", "timestamp", "outcome"))
    return new.groupBy("outcome").agg(F.count(F.lit(1)).alias("appended"), F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("h2_log_query", d.with_ctes("SELECT audit_id, user_email, resource_fqn, outcome FROM cat_audit WHERE event_type = 'ASSET_READ' AND contains(resource_fqn, 'table_1') AND \"timestamp\" >= TIMESTAMP '2024-01-05' AND \"timestamp\" <= TIMESTAMP '2024-01-25' ORDER BY \"timestamp\" DESC, audit_id LIMIT 100", "cat_audit"))
def h2(spark, root):
    found = audit.query(d.audit(spark, root), event_type="ASSET_READ", resource_fqn="table_1", start="2024-01-05", end="2024-01-25", limit=100, fqn_match="contains")
    return found.select("audit_id", "user_email", "resource_fqn", "outcome")


@query("h2_log_query_exact", d.with_ctes("SELECT audit_id, event_type FROM cat_audit WHERE user_email = 'user7@example.com' AND resource_fqn = 'postgresql.public.table_7' ORDER BY \"timestamp\" DESC, audit_id LIMIT 1000", "cat_audit"))
def h2_exact(spark, root):
    return audit.query(d.audit(spark, root), user_email="user7@example.com", resource_fqn="postgresql.public.table_7", limit=1000).select("audit_id", "event_type")


@query("h3_pii_access_report", d.with_ctes("SELECT user_email, count(*) AS access_count, count(DISTINCT resource_fqn) AS distinct_resources, min(\"timestamp\") AS first_access, max(\"timestamp\") AS last_access FROM cat_audit WHERE event_type = 'PII_ACCESS' AND \"timestamp\" >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AND \"timestamp\" < TIMESTAMP '2024-01-31' GROUP BY 1", "cat_audit"))
def h3(spark, root):
    return audit.pii_access_report(d.audit(spark, root), d.AS_OF, 14)


@query("h4_days_activity", d.with_ctes("SELECT audit_id, event_type, outcome FROM cat_audit WHERE CAST(\"timestamp\" AS DATE) = DATE '2024-01-15'", "cat_audit"))
def h4(spark, root):
    return audit.on_day(d.audit(spark, root), "2024-01-15").select("audit_id", "event_type", "outcome")


@query("h5_event_counts", d.with_ctes("SELECT event_type, count(*) AS event_count FROM cat_audit GROUP BY 1", "cat_audit"))
def h5(spark, root):
    return audit.count_by(d.audit(spark, root), "event_type")


@query("h6_outcome_counts", d.with_ctes("SELECT event_type, outcome, count(*) AS event_count FROM cat_audit GROUP BY 1, 2", "cat_audit"))
def h6(spark, root):
    return audit.count_by(d.audit(spark, root), "event_type", "outcome")


@query("h7_vocabulary", "SELECT CASE WHEN event_type IN ('view', 'signup') THEN 'event_type' WHEN event_id % 7 = 0 THEN 'outcome' ELSE 'accepted' END AS state, count(*) AS events FROM events GROUP BY 1")
def h7(spark, root):
    """Events with unknown types or outcomes go to quarantine with the reason."""
    raw = F.col("action")
    log = d.audit(spark, root).withColumn("event_type", F.when(raw == "view", "VIEWED").when(raw == "signup", None).otherwise(F.col("event_type")))
    log = log.withColumn("outcome", F.when(F.substring("audit_id", 3, 20).cast("bigint") % 7 == 0, "UNKNOWN").otherwise(F.col("outcome")))
    good, bad = audit.valid_and_quarantined(log)
    return good.select(F.lit("accepted").alias("state")).unionByName(bad.select(F.col("reject_reason").alias("state"))).groupBy("state").agg(F.count(F.lit(1)).alias("events"))


@query("h8_payload_values", "SELECT CAST(props ->> '$.k' AS INT) AS k, count(*) AS events FROM events GROUP BY 1")
def h8(spark, root):
    return audit.payload_value(d.events(spark, root), "props", "$.k", "int", "k").groupBy("k").agg(F.count(F.lit(1)).alias("events"))


@query("h9_normalised_emitters", """
    SELECT service, outcome, count(*) AS events, count(metadata) AS with_metadata FROM (
      SELECT 'auth-service' AS service, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome, props AS metadata FROM events WHERE event_type IN ('error', 'signup')
      UNION ALL SELECT 'connector-service', 'SUCCESS', props FROM events WHERE event_type = 'view'
      UNION ALL SELECT 'term-service', 'SUCCESS', NULL FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY 1, 2""")
def h9(spark, root):
    e = d.events(spark, root)
    base = [F.concat(F.lit("a-"), "event_id").alias("audit_id"), F.col("ts").alias("timestamp"), F.upper("event_type").alias("event_type")]
    frames = {
        "auth-service": e.filter(F.col("event_type").isin("error", "signup")).select(*base, F.when(F.col("event_type") == "error", "FAILURE").alias("outcome"), F.col("props").alias("metadata")),
        "connector-service": e.filter(F.col("event_type") == "view").select(*base, F.col("props").alias("details")),
        "term-service": e.filter(F.col("event_type").isin("click", "purchase")).select(*base),
    }
    return audit.normalise(frames).groupBy("service", "outcome").agg(F.count(F.lit(1)).alias("events"), F.count("metadata").alias("with_metadata"))


# ---- I: access -------------------------------------------------------------
def _matrix_sql(matrix) -> str:
    rows = [f"({d.q(res)}, {d.q(act)}, {vocab.ROLES.index(need)})" for res, acts in matrix.items() for act, need in acts.items()]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(res, act, need)"


_ROLE_RANK = f"(coalesce(list_position({d.sql_list(vocab.ROLES)}, role), 0) - 1)"
_RBAC = f"SELECT event_id, coalesce({_ROLE_RANK} >= need, false) AS allowed FROM requests LEFT JOIN ({_matrix_sql(vocab.RBAC_MATRIX)}) ON res = resource AND act = action"


@query("i1_rbac_decisions", d.with_ctes(_RBAC, "requests"))
def i1(spark, root):
    return access.rbac_decisions(d.requests(spark, root)).select("event_id", "allowed")


_OPA = f"""SELECT event_id, role, coalesce(ranked AND NOT coalesce(blocked, false), false) AS base, coalesce(role = 'admin' AND emergency_access = true, false) AS emergency,
    coalesce(role = 'data_steward' AND resource = 'asset' AND action IN ('write', 'delete') AND (coalesce(asset_steward = user_email, false) OR coalesce(asset_owner = user_email, false)), false) AS steward,
    coalesce(role = 'admin' AND resource = 'column' AND action = 'read_pii_value' AND justification IS NOT NULL AND justification <> '', false) AS justified,
    coalesce(role = 'viewer' AND sensitivity_level IN ('CONFIDENTIAL', 'RESTRICTED'), false) AS hidden
    FROM (SELECT *, {_ROLE_RANK} >= need AS ranked FROM requests LEFT JOIN ({_matrix_sql(vocab.OPA_MATRIX)}) ON res = resource AND act = action)"""


@query("i2_policy_as_written", d.with_ctes(f"SELECT event_id, base OR emergency OR steward OR justified AS allowed FROM ({_OPA})", "requests"))
def i2(spark, root):
    return access.policy_decisions(d.requests(spark, root)).select("event_id", "allowed")


@query("i2_policy_intended", d.with_ctes(f"SELECT event_id, (base AND NOT hidden) OR emergency OR steward OR justified AS allowed FROM ({_OPA})", "requests"))
def i2_intended(spark, root):
    return access.policy_decisions(d.requests(spark, root), "intended").select("event_id", "allowed")


@query("i3_decisions_by_role", d.with_ctes(f"SELECT role, count(*) AS requests, count(*) FILTER (WHERE ok) AS allowed_count, count(*) FILTER (WHERE NOT ok) AS denied_count FROM (SELECT role, base OR emergency OR steward OR justified AS ok FROM ({_OPA})) GROUP BY 1", "requests"))
def i3(spark, root):
    return access.decision_counts(access.policy_decisions(d.requests(spark, root)))


@query("i5_visible_assets", d.with_ctes("SELECT fqn, sensitivity_level FROM cat_assets WHERE sensitivity_level IN ('PUBLIC', 'INTERNAL')", "cat_assets"))
def i5(spark, root):
    return access.visible_assets(d.assets(spark, root), "viewer").select("fqn", "sensitivity_level")


_USERS = f"SELECT 'user' || c_custkey || '@example.com' AS email, c_name AS full_name, {d.sql_list(vocab.ROLES)}[c_nationkey % 4 + 1] AS role, c_acctbal > 0 AS is_active FROM customer"
_USER_HIT = "(contains(lower(email), '77') OR contains(lower(full_name), '77')) AND role = 'data_steward' AND is_active"


@query("i6_user_search", f"SELECT email, full_name, (SELECT count(*) FROM ({_USERS}) WHERE {_USER_HIT}) AS total, CAST(ceil((SELECT count(*) FROM ({_USERS}) WHERE {_USER_HIT}) / 20.0) AS BIGINT) AS total_pages FROM ({_USERS}) WHERE {_USER_HIT} ORDER BY email LIMIT 20")
def i6(spark, root):
    users = d.table(spark, root, "customer").select(
        F.concat(F.lit("user"), "c_custkey", F.lit("@example.com")).alias("email"), F.col("c_name").alias("full_name"),
        d.pick(vocab.ROLES, F.col("c_nationkey") % 4).alias("role"), (F.col("c_acctbal") > 0).alias("is_active"))
    return catalog.page(access.user_search(users, "77", "data_steward", True), ["email"], 20).select("email", "full_name", "total", "total_pages")


@query("i7_token_outcomes", """
    WITH issued AS (SELECT user_id AS jti, min(ts) AS issued_at, min(ts) + INTERVAL 20 DAY AS expires_at, arg_min('10.0.0.' || (event_id % 3), event_id) AS ip FROM events WHERE user_id % 9 <> 8 GROUP BY 1),
    revoked AS (SELECT user_id AS jti, min(ts) AS revoked_at FROM events WHERE event_type = 'error' AND user_id % 5 = 0 GROUP BY 1)
    SELECT outcome, count(*) AS uses FROM (SELECT CASE WHEN i.jti IS NULL THEN 'unknown' WHEN e.ts > i.expires_at THEN 'expired' WHEN r.revoked_at <= e.ts THEN 'revoked' WHEN i.ip <> '10.0.0.' || (e.event_id % 3) THEN 'ip_mismatch' ELSE 'valid' END AS outcome
      FROM events e LEFT JOIN issued i ON i.jti = e.user_id LEFT JOIN revoked r ON r.jti = e.user_id) GROUP BY 1""")
def i7(spark, root):
    e = d.events(spark, root)
    ip = F.concat(F.lit("10.0.0."), F.col("event_id") % 3)
    uses = e.select(F.col("user_id").alias("jti"), F.col("ts").alias("used_at"), ip.alias("request_ip"))
    issued = e.filter(F.col("user_id") % 9 != 8).groupBy(F.col("user_id").alias("jti")).agg((F.min("ts") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"), F.min_by(ip, "event_id").alias("ip"))
    revoked = e.filter((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0)).select(F.col("user_id").alias("jti"), F.col("ts").alias("revoked_at"))
    return access.token_outcomes(uses, issued, revoked).groupBy("outcome").agg(F.count(F.lit(1)).alias("uses"))


# ---- L: alerts -------------------------------------------------------------
_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


def _bucket(seconds: int) -> str:
    return f"({_EPOCH} - {_EPOCH} % {seconds})"




def _error():
    return F.col("event_type") == "error"


_START, _STOP = 1704067200, 1706659200  # 2024-01-01 to 2024-01-31, UTC


@query("l1_event_rates", f"SELECT event_type, {_bucket(300)} AS bucket, count(*) AS n, count(*) / 300.0::DOUBLE AS rate FROM events GROUP BY 1, 2")
def l1(spark, root):
    return alerts.rates(d.events(spark, root), 300, ["event_type"])


@query("l2_counter_increase", f"""
    WITH steps AS (SELECT user_id, {_bucket(86400)} AS bucket, v, lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT *, CAST(value * 100 AS BIGINT) AS v FROM events))
    SELECT user_id, bucket, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END) AS BIGINT) AS increase FROM steps GROUP BY 1, 2""")
def l2(spark, root):
    """Daily increase of a counter per user, drops counted as restarts."""
    e = d.events(spark, root).select("user_id", "ts", F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return alerts.counter_increase(e, ["user_id"], 86400)


@query("l2_daily_counts", f"SELECT event_type, {_bucket(86400)} AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def l2_counts(spark, root):
    return alerts.bucketed(d.events(spark, root), 86400, ["event_type"])


@query("l3_error_ratio", f"SELECT user_id % 10 AS job, {_bucket(3600)} AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1, 2")
def l3(spark, root):
    e = d.events(spark, root).withColumn("job", F.col("user_id") % 10)
    return alerts.error_ratio(e, _error(), 3600, ["job"])


_LE = [f"count(*) FILTER (WHERE value <= {b})" for b in vocab.DURATION_BUCKETS]


def _quantile_sql(q: float) -> str:
    prev = ["0", *_LE[:-1]]
    low = [0, *vocab.DURATION_BUCKETS[:-1]]
    whens = " ".join(
        f"WHEN {_LE[i]} >= {q}::DOUBLE * count(*) THEN {low[i]}.0::DOUBLE + ({b}.0::DOUBLE - {low[i]}.0::DOUBLE) * (({q}::DOUBLE * count(*) - {prev[i]}) / ({_LE[i]} - {prev[i]}))"
        for i, b in enumerate(vocab.DURATION_BUCKETS))
    return f"CASE {whens} ELSE {vocab.DURATION_BUCKETS[-1]}.0::DOUBLE END"


@query("l4_histogram_quantiles", f"SELECT event_type, {_bucket(86400)} AS bucket, count(*) AS n, round({_quantile_sql(0.95)}, 6) AS p95, round({_quantile_sql(0.99)}, 6) AS p99 FROM events GROUP BY 1, 2")
def l4(spark, root):
    e = d.events(spark, root)
    p95 = alerts.histogram_quantile(e, "value", 0.95, 86400, ["event_type"]).withColumnRenamed("quantile", "p95")
    p99 = alerts.histogram_quantile(e, "value", 0.99, 86400, ["event_type"]).drop("n").withColumnRenamed("quantile", "p99")
    return p95.join(p99, ["event_type", "bucket"]).select("event_type", "bucket", "n", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


def _islands(grid: str, condition: str, step: int, hold: int, key: str = "job") -> str:
    return f"""runs AS (SELECT {key}, bucket, bucket - row_number() OVER (PARTITION BY {key} ORDER BY bucket) * {step} AS run FROM ({grid}) WHERE {condition}),
    firing AS (SELECT {key}, min(bucket) AS started_at, max(bucket) AS ended_at, count(*) AS points, min(bucket) + {hold} AS fires_at FROM runs GROUP BY {key}, run HAVING max(bucket) - min(bucket) >= {hold})"""


_JOB_GRID = f"SELECT user_id % 3 AS job, {_bucket(3600)} AS bucket, count(*) FILTER (WHERE event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1, 2"


@query("l5_held_alerts", f"WITH {_islands(_JOB_GRID, 'ratio > 0.1', 3600, 7200)} SELECT * FROM firing")
def l5(spark, root):
    """Episodes in which a job's hourly error ratio stays above 10 % for two hours."""
    e = d.events(spark, root).withColumn("job", F.col("user_id") % 3)
    grid = alerts.error_ratio(e, _error(), 3600, ["job"])
    return alerts.firing(grid, ["job"], "bucket", F.col("ratio") > 0.1, 3600, 7200)


@query("l6_silent_windows", f"SELECT t.event_type, g.bucket FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest(range({_START}, {_STOP}, 3600)) AS bucket) g WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.event_type AND {_bucket(3600)} = g.bucket)")
def l6(spark, root):
    """Hours in which an event type never occurs."""
    return alerts.silent_windows(d.events(spark, root), ["event_type"], 3600, _START, _STOP)


@query("l7_budget_burn", f"""
    WITH per AS (SELECT {_bucket(300)} AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1),
    grid AS (SELECT unnest(range((SELECT min(bucket) FROM per) + 300, (SELECT max(bucket) FROM per) + 21601, 300)) AS "at"),
    w AS (SELECT "at", sum(e) FILTER (WHERE bucket >= "at" - 3600) AS e1, sum(n) FILTER (WHERE bucket >= "at" - 3600) AS n1, sum(e) AS e6, sum(n) AS n6
          FROM grid JOIN per ON bucket >= "at" - 21600 AND bucket < "at" GROUP BY 1)
    SELECT "at", round(e1 / n1, 6) AS ratio_1h, round(e6 / n6, 6) AS ratio_6h, e1 / n1 > 14.4 * 0.0001 AS fast_burn, e6 / n6 > 6 * 0.0001 AS slow_burn FROM w""")
def l7(spark, root):
    """Error-budget burn over one and six hours, evaluated every five minutes, idle ones too."""
    e = d.events(spark, root)
    fast = alerts.sliding_ratio(e, _error(), 3600, 300).select("at", F.round("ratio", 6).alias("ratio_1h"), (F.col("ratio") > 14.4 * 0.0001).alias("fast_burn"))
    slow = alerts.sliding_ratio(e, _error(), 21600, 300).select("at", F.round("ratio", 6).alias("ratio_6h"), (F.col("ratio") > 6 * 0.0001).alias("slow_burn"))
    return slow.join(fast, "at", "left").select("at", "ratio_1h", "ratio_6h", "fast_burn", "slow_burn")


@query("l8_availability", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, round(100.0::DOUBLE * (1 - count(*) FILTER (WHERE event_type = 'error') / count(*)), 6) AS availability_pct FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FILTER (WHERE event_type = 'error'), round(100.0::DOUBLE * (1 - count(*) FILTER (WHERE event_type = 'error') / count(*)), 6) FROM events")
def l8(spark, root):
    e = d.events(spark, root)
    daily = alerts.availability(e, _error(), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return daily.unionByName(alerts.availability(e, _error()).withColumn("day", F.lit("all")))


@query("l9_stuck_jobs", f"""
    SELECT s.job_id, started_at, {_STOP} - started_at AS running_seconds FROM (SELECT event_id % 1000 AS job_id, min({_EPOCH}) AS started_at FROM events WHERE event_type = 'view' GROUP BY 1) s
    WHERE started_at < {_STOP} - 3600 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.event_id % 1000 = s.job_id)""")
def l9(spark, root):
    e = d.events(spark, root).withColumn("job_id", F.col("event_id") % 1000)
    starts = e.filter(F.col("event_type") == "view").groupBy("job_id").agg(F.min(epoch_seconds("ts")).alias("started_at"))
    return alerts.stuck_jobs(starts, e.filter(F.col("event_type") == "purchase"), _STOP)


@query("l10_failure_ratio", f"SELECT user_id % 20 AS source, {_bucket(900)} AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.2")
def l10(spark, root):
    e = d.events(spark, root).withColumn("source", F.col("user_id") % 20)
    return alerts.failure_alerts(e, _error(), ["source"])


_THRESHOLDS = {"view": 50.0, "click": 80.0, "purchase": 100.0, "error": 20.0}


@query("l11_gauge_thresholds", f"SELECT user_id, event_type AS metric, value, threshold, sampled_at FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS sampled_at, {d.sql_case('event_type', _THRESHOLDS)}::DOUBLE AS threshold FROM events GROUP BY 1, 2) WHERE value > threshold")
def l11(spark, root):
    """Newest value of every (user, metric) gauge above its metric's limit."""
    e = d.events(spark, root).select("user_id", F.col("event_type").alias("metric"), "value", "ts", F.col("event_id").alias("seq"))
    return alerts.gauge_alerts(alerts.latest_gauges(e, ["user_id", "metric"]), "metric", _THRESHOLDS)


@query("l12_auth_spikes", f"SELECT user_id, {_bucket(86400)} AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 2")
def l12(spark, root):
    return alerts.spikes(d.events(spark, root).filter(_error()), ["user_id"], 86400, 2)



@query("l13_grouped_alerts", f"""
    WITH grid AS ({_JOB_GRID.replace("% 3 AS", "% 12 AS")}), wr AS (SELECT job, bucket, bucket - row_number() OVER (PARTITION BY job ORDER BY bucket) * 3600 AS run FROM grid WHERE ratio > 0.2),
    cr AS (SELECT job, bucket, bucket - row_number() OVER (PARTITION BY job ORDER BY bucket) * 3600 AS run FROM grid WHERE ratio > 0.6),
    w AS (SELECT 'job-' || job AS service, min(bucket) AS started_at FROM wr GROUP BY job, run HAVING max(bucket) - min(bucket) >= 3600), c AS (SELECT 'job-' || job AS service, min(bucket) AS started_at FROM cr GROUP BY job, run HAVING max(bucket) - min(bucket) >= 7200),
    alive AS (SELECT 'critical' AS severity, * FROM c UNION ALL SELECT 'warning', * FROM w WHERE service NOT IN (SELECT service FROM c))
    SELECT 'ErrorRate' AS alertname, service, severity, count(*) AS alert_count, min(started_at) AS first_at FROM alive GROUP BY 2, 3""")
def l13(spark, root):
    """Two severities of one alert; a critical one silences the service's warnings."""
    e = d.events(spark, root).withColumn("job", F.col("user_id") % 12)
    grid = alerts.error_ratio(e, _error(), 3600, ["job"])
    both = None
    for severity, limit, hold in (("warning", 0.2, 3600), ("critical", 0.6, 7200)):
        one = alerts.firing(grid, ["job"], "bucket", F.col("ratio") > limit, 3600, hold).select(
            F.lit("ErrorRate").alias("alertname"), F.concat(F.lit("job-"), "job").alias("service"), F.lit(severity).alias("severity"), "started_at")
        both = one if both is None else both.unionByName(one)
    return alerts.grouped_alerts(both)


# ---- M: declared transforms ------------------------------------------------
@query("m1_stage_customers", "SELECT c_custkey AS customer_id, c_mktsegment || ' ' || c_name AS full_name, regexp_replace(replace(lower(c_name), '#', '.') || '@example.com', '(.{2}).+(@.+)', '\\1***\\2') AS email_masked, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS DOUBLE) AS account_balance, lower(c_mktsegment) AS segment FROM customer")
def m1(spark, root):
    return transforms.stage_customers(d.table(spark, root, "customer"))


@query("m2_stage_transactions", "SELECT l_orderkey AS transaction_id, l_linenumber AS line_id, l_shipdate AS txn_timestamp, round(l_extendedprice * CASE l_linestatus WHEN 'O' THEN 1.25::DOUBLE WHEN 'F' THEN 0.5::DOUBLE END, 2) AS amount_usd, l_returnflag = 'N' AS is_successful FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def m2(spark, root):
    return transforms.stage_transactions(d.table(spark, root, "lineitem"))


_SUM2 = "CAST(sum(CAST({} AS DECIMAL(28, 2))) AS DOUBLE)"


@query("m3_product_margins", f"""
    SELECT p_partkey AS product_id, p_brand AS sku, p_type AS category, p_retailprice AS retail_price, round(a / u, 4) AS cost_price, round((p_retailprice - a / u) / p_retailprice, 6) AS margin_pct
    FROM part LEFT JOIN (SELECT l_partkey, {_SUM2.format("l_extendedprice")} AS a, {_SUM2.format("l_quantity")} AS u FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def m3(spark, root):
    return transforms.stage_products(d.table(spark, root, "part"), d.table(spark, root, "lineitem"))


def _status_sum(status: str) -> str:
    return f"CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) FILTER (WHERE o_orderstatus = '{status}') AS DOUBLE)"


@query("m4_account_summary", f"SELECT c_custkey AS customer_id, strftime(o_orderdate, '%Y-%m') AS summary_month, {_status_sum('F')} AS total_credits, {_status_sum('O')} AS total_debits, any_value(c_acctbal) AS opening_balance FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def m4(spark, root):
    return transforms.account_summary(d.table(spark, root, "orders"), d.table(spark, root, "customer"))


_TIER = "CASE WHEN s > 0.9 THEN 'HIGH' WHEN s > 0.5 THEN 'MEDIUM' ELSE 'LOW' END"
_RISK = f"SELECT o_orderkey, o_custkey, o_orderdate, round(s, 6) AS fraud_score, {_TIER} AS risk_tier FROM (SELECT *, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS s FROM orders)"


@query("m5_risk_tiers", _RISK)
def m5(spark, root):
    return transforms.risk_tiers(d.table(spark, root, "orders"))


@query("m6_customer_360", f"""
    WITH monthly AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS m, sum(CAST(o_totalprice AS DECIMAL(28, 2))) AS t FROM orders GROUP BY 1, 2), totals AS (SELECT o_custkey, CAST(sum(t) AS DOUBLE) AS total, count(*) AS months FROM monthly GROUP BY 1)
    SELECT c_custkey AS customer_id, o_orderkey, lower(c_mktsegment) AS segment, round(c_acctbal + total, 2) AS lifetime_value, round(total / months, 4) AS avg_monthly_spend,
           max(o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 90 PRECEDING AND CURRENT ROW) AS max_order_90
    FROM orders o JOIN customer ON c_custkey = o.o_custkey JOIN totals t ON t.o_custkey = o.o_custkey""")
def m6(spark, root):
    return transforms.customer_360(d.table(spark, root, "orders"), d.table(spark, root, "customer"))


_M7 = f"""SELECT p_partkey AS product_id, p_name AS product_name, p_retailprice AS avg_selling_price, round(q / n, 4) AS avg_quantity, coalesce(n, 0) AS line_count, round(100.0::DOUBLE * r / n, 4) AS returned_pct
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, {_SUM2.format("l_quantity")} AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""


@query("m7_product_metrics", _M7)
def m7(spark, root):
    return transforms.product_metrics(d.table(spark, root, "part"), d.table(spark, root, "lineitem"))


@query("m8_risk_dashboard", f"""
    SELECT c_mktsegment AS segment, count(*) FILTER (WHERE risk_tier = 'HIGH') AS high_risk_count, count(*) FILTER (WHERE risk_tier = 'HIGH' AND CAST(o_orderdate AS DATE) = DATE '2001-07-30') AS high_risk_today,
           round(quantile_cont(fraud_score, 0.99), 9) AS p99_score FROM ({_RISK}) JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def m8(spark, root):
    return transforms.risk_dashboard(d.table(spark, root, "orders"), d.table(spark, root, "customer"), "2001-07-30")


@query("m9_executive_summary", f"""
    SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, {_SUM2.format("o_totalprice")} AS revenue, count(DISTINCT o_custkey) AS active_customers,
           count(DISTINCT o_custkey) FILTER (WHERE o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 7 DAY AND o_orderdate <= TIMESTAMP '2001-08-01') AS active_last_7d, {_status_sum('F')} AS weekly_credits, {_status_sum('O')} AS weekly_debits FROM orders GROUP BY 1""")
def m9(spark, root):
    return transforms.executive_summary(d.table(spark, root, "orders"), "2001-08-01")


@query("m10_product_report", f"SELECT product_id, avg_quantity AS avg_rating, line_count AS review_count, avg_selling_price AS price FROM ({_M7})")
def m10(spark, root):
    return transforms.product_report(transforms.product_metrics(d.table(spark, root, "part"), d.table(spark, root, "lineitem")))


@query("m11_fraud_features", """
    WITH v AS (SELECT *, CAST(value AS DECIMAL(18, 2)) AS x FROM events), m AS (SELECT user_id, CAST(sum(x) AS DOUBLE) AS s, CAST(sum(CAST(x * x AS DECIMAL(38, 4))) AS DOUBLE) AS ss, count(x) AS n FROM v GROUP BY 1)
    SELECT event_id, v.user_id, round(CASE WHEN n > 1 AND sqrt((ss - s * s / n) / (n - 1)) > 0 THEN (CAST(x AS DOUBLE) - s / n) / sqrt((ss - s * s / n) / (n - 1)) END, 6) AS z_score,
           CAST(sum(x) OVER (PARTITION BY v.user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling_sum,
           CAST(event_type = 'view' AS INT) AS is_view, CAST(event_type = 'click' AS INT) AS is_click, CAST(event_type = 'purchase' AS INT) AS is_purchase, CAST(event_type = 'signup' AS INT) AS is_signup, CAST(event_type = 'error' AS INT) AS is_error FROM v JOIN m ON m.user_id = v.user_id""")
def m11(spark, root):
    return transforms.fraud_features(d.events(spark, root))


@query("m12_churn_features", """
    WITH monthly AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(28, 2))) AS spend FROM orders GROUP BY 1, 2), life AS (SELECT o_custkey, CAST(sum(spend) AS DOUBLE) AS life FROM monthly GROUP BY 1),
    codes AS (SELECT c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer))
    SELECT m.o_custkey AS customer_id, month, CAST(spend - lag(spend, 3) OVER (PARTITION BY m.o_custkey ORDER BY month) AS DOUBLE) AS spend_trend_3m, code AS segment_encoded,
           CASE WHEN CAST(spend AS DOUBLE) / (SELECT max(o_totalprice) FROM orders) > 0.9 THEN 1.0::DOUBLE WHEN CAST(spend AS DOUBLE) / (SELECT max(o_totalprice) FROM orders) > 0.5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS risk_score, round(ln(life + 1), 6) AS lifetime_value_log
    FROM monthly m JOIN life l ON l.o_custkey = m.o_custkey JOIN customer c ON c_custkey = m.o_custkey JOIN codes k ON k.c_mktsegment = c.c_mktsegment""")
def m12(spark, root):
    return transforms.churn_features(d.table(spark, root, "orders"), d.table(spark, root, "customer"))


@query("m13_daily_revenue", f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS date_day, {_SUM2.format('o_totalprice')} AS revenue_usd, count(*) AS order_count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def m13(spark, root):
    return transforms.daily_revenue(d.table(spark, root, "orders"))


@query("m14_attribution", f"SELECT c_mktsegment AS segment, count(*) AS conversions, count(DISTINCT c_custkey) AS customers, {_SUM2.format('o_totalprice')} AS revenue FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def m14(spark, root):
    return transforms.attribution(d.table(spark, root, "orders"), d.table(spark, root, "customer"))


@query("m15_orders_from_events", "SELECT event_id AS order_id, user_id AS customer_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ordered_at, value AS amount FROM events WHERE event_type = 'purchase'")
def m15(spark, root):
    return transforms.orders_from_events(d.events(spark, root))
