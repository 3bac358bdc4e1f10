"""The ETL transforms the lineage records declare, over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import exact_quantile, first_per_key, framed
from ..functions.scalars import exact_sum, mask_email

# Conversion rate to USD by line status.
FX_RATES = {"O": 1.25, "F": 0.5}
# Risk score of a tier.
TIER_SCORE = {"HIGH": 1.0, "MEDIUM": 0.5}


def risk_tier(score: Column) -> Column:
    return F.when(score > 0.9, "HIGH").when(score > 0.5, "MEDIUM").otherwise("LOW")



def stage_customers(customer: DataFrame) -> DataFrame:
    email = F.concat(F.regexp_replace(F.lower("c_name"), "#", "."), F.lit("@example.com"))
    return customer.select(
        F.col("c_custkey").alias("customer_id"), F.concat("c_mktsegment", F.lit(" "), "c_name").alias("full_name"),
        mask_email(email).alias("email_masked"), F.col("c_acctbal").cast("decimal(18,2)").cast("double").alias("account_balance"),
        F.lower("c_mktsegment").alias("segment"),
    )


def stage_transactions(lineitem: DataFrame, rates: dict[str, float] = FX_RATES) -> DataFrame:
    """First copy of every (order, line), amount in USD, success flag."""
    once = first_per_key(
        lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus"),
        ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"],
    )
    rate = F.try_element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("l_linestatus"))
    return once.select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_linenumber").alias("line_id"), F.col("l_shipdate").alias("txn_timestamp"),
        F.round(F.col("l_extendedprice") * rate, 2).alias("amount_usd"), (F.col("l_returnflag") == "N").alias("is_successful"),
    )


def stage_products(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Margin of the retail price over the mean unit price sold. Lines are reduced before the join."""
    cost = lineitem.groupBy("l_partkey").agg(exact_sum("l_extendedprice").alias("_amount"), exact_sum("l_quantity").alias("_units"))
    joined = part.join(cost, part.p_partkey == cost.l_partkey, "left")
    unit = F.col("_amount") / F.col("_units")
    return joined.select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("sku"), F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("retail_price"), F.round(unit, 4).alias("cost_price"),
        F.round((F.col("p_retailprice") - unit) / F.col("p_retailprice"), 6).alias("margin_pct"),
    )


def account_summary(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Monthly credits and debits per customer with the opening balance."""
    month = F.date_format("o_orderdate", "yyyy-MM").alias("summary_month")
    per = orders.groupBy("o_custkey", month).agg(
        exact_sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("total_credits"),
        exact_sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("total_debits"),
    )
    return per.join(customer, per.o_custkey == customer.c_custkey).select(
        F.col("c_custkey").alias("customer_id"), "summary_month", "total_credits", "total_debits", F.col("c_acctbal").alias("opening_balance")
    )


def risk_tiers(orders: DataFrame) -> DataFrame:
    """Score relative to the largest order (a scalar subquery, not a global window)."""
    top = orders.agg(F.max("o_totalprice").alias("m")).scalar()
    scored = orders.select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") / top).alias("_s"))
    return scored.select("o_orderkey", "o_custkey", "o_orderdate", F.round("_s", 6).alias("fraud_score"), risk_tier(F.col("_s")).alias("risk_tier"))


def customer_360(orders: DataFrame, customer: DataFrame, **limits) -> DataFrame:
    """Per order: lifetime value, mean monthly spend, and the greatest order among it and the 90 before."""
    slim = orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    rolled = framed(
        slim, ["o_custkey"], ["o_orderdate", "o_orderkey"], 90,
        lambda w: {"max_90": F.max("o_totalprice").over(w.rowsBetween(-90, 0))}, **limits,
    )
    monthly = slim.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("_m")).agg(F.sum(F.col("o_totalprice").cast("decimal(28,2)")).alias("_t"))
    totals = monthly.groupBy("o_custkey").agg(F.sum("_t").cast("double").alias("_total"), F.count(F.lit(1)).alias("_months"))
    profile = customer.join(totals, customer.c_custkey == totals.o_custkey).select(
        "c_custkey", F.lower("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") + F.col("_total"), 2).alias("lifetime_value"),
        F.round(F.col("_total") / F.col("_months"), 4).alias("avg_monthly_spend"),
    )
    return rolled.join(profile, rolled.o_custkey == profile.c_custkey).select(
        F.col("c_custkey").alias("customer_id"), "o_orderkey", "segment", "lifetime_value", "avg_monthly_spend", F.col("max_90").alias("max_order_90")
    )


def product_metrics(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    sold = lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("line_count"), exact_sum("l_quantity").alias("_q"), F.count_if(F.col("l_returnflag") == "R").alias("_r")
    )
    joined = part.join(sold, part.p_partkey == sold.l_partkey, "left")
    n = F.coalesce("line_count", F.lit(0))
    return joined.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_retailprice").alias("avg_selling_price"),
        F.round(F.col("_q") / F.col("line_count"), 4).alias("avg_quantity"), n.cast("bigint").alias("line_count"),
        F.round(100.0 * F.col("_r") / F.col("line_count"), 4).alias("returned_pct"),
    )


def risk_dashboard(orders: DataFrame, customer: DataFrame, today: str) -> DataFrame:
    """High-risk orders, exact 99th percentile and today's high-risk orders by segment."""
    scored = risk_tiers(orders).join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.lit(today).cast("timestamp_ntz")
    counts = scored.groupBy("c_mktsegment").agg(
        F.count_if(F.col("risk_tier") == "HIGH").alias("high_risk_count"),
        F.count_if((F.col("risk_tier") == "HIGH") & (F.col("o_orderdate") >= day) & (F.col("o_orderdate") < day + F.expr("INTERVAL 1 DAY"))).alias("high_risk_today"),
    )
    p99 = exact_quantile(scored, ["c_mktsegment"], "fraud_score", 0.99, "p99")
    return counts.join(p99, "c_mktsegment").select(F.col("c_mktsegment").alias("segment"), "high_risk_count", "high_risk_today", F.round("p99", 9).alias("p99_score"))


def executive_summary(orders: DataFrame, as_of: str) -> DataFrame:
    """Weekly totals with the customers active in each week, and those of the last seven days."""
    day = F.lit(as_of).cast("timestamp_ntz")
    recent = (F.col("o_orderdate") > day - F.expr("INTERVAL 7 DAYS")) & (F.col("o_orderdate") <= day)
    week = F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("week")
    return orders.groupBy(week).agg(
        exact_sum("o_totalprice").alias("revenue"), F.count_distinct("o_custkey").alias("active_customers"),
        F.count_distinct(F.when(recent, F.col("o_custkey"))).alias("active_last_7d"),
        exact_sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("weekly_credits"),
        exact_sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("weekly_debits"),
    )


def product_report(metrics: DataFrame) -> DataFrame:
    return metrics.select("product_id", F.col("avg_quantity").alias("avg_rating"), F.col("line_count").alias("review_count"), F.col("avg_selling_price").alias("price"))


def fraud_features(events: DataFrame, **limits) -> DataFrame:
    """Per event: z-score within its user, rolling sum over it and the seven before, one-hot type."""
    slim = events.select("event_id", "ts", "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("_v"))
    moments = slim.groupBy("user_id").agg(
        F.sum("_v").cast("double").alias("_s"), F.sum((F.col("_v") * F.col("_v")).cast("decimal(38,4)")).cast("double").alias("_ss"), F.count("_v").alias("_n")
    )
    mean = F.col("_s") / F.col("_n")
    spread = F.sqrt((F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1))
    rolled = framed(slim, ["user_id"], ["ts", "event_id"], 7, lambda w: {"_roll": F.sum("_v").over(w.rowsBetween(-7, 0))}, **limits)
    joined = rolled.join(moments, "user_id")
    one_hot = [F.when(F.col("event_type") == t, 1).otherwise(0).alias(f"is_{t}") for t in ("view", "click", "purchase", "signup", "error")]
    z = F.when((F.col("_n") > 1) & (spread > 0), (F.col("_v").cast("double") - mean) / spread)
    return joined.select("event_id", "user_id", F.round(z, 6).alias("z_score"), F.col("_roll").cast("double").alias("rolling_sum"), *one_hot)


def churn_features(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Per customer and month: spend trend over three months, encoded segment, tier score, log of lifetime value.

    The lag window runs over one row per customer and month, a size set by the calendar.
    Segment codes are ranks over the distinct segments, a small vocabulary.
    """
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    monthly = orders.groupBy("o_custkey", month).agg(F.sum(F.col("o_totalprice").cast("decimal(28,2)")).alias("_spend"))
    w = Window.partitionBy("o_custkey").orderBy("month")
    trend = monthly.withColumn("_trend", (F.col("_spend") - F.lag("_spend", 3).over(w)).cast("double"))
    life = monthly.groupBy("o_custkey").agg(F.sum("_spend").cast("double").alias("_life"))
    codes = customer.select("c_mktsegment").distinct().withColumn("segment_encoded", F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1)
    best = orders.agg(F.max("o_totalprice").alias("m")).scalar()
    tier = risk_tier(F.col("_spend").cast("double") / best)
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TIER_SCORE.items() for x in kv]), tier), F.lit(0.0))
    return (
        trend.join(life, "o_custkey")
        .join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(codes, "c_mktsegment")
        .select(
            F.col("o_custkey").alias("customer_id"), "month", F.col("_trend").alias("spend_trend_3m"), "segment_encoded",
            score.alias("risk_score"), F.round(F.log1p("_life"), 6).alias("lifetime_value_log"),
        )
    )


def daily_revenue(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("o_orderstatus") == "F").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_day")).agg(
        exact_sum("o_totalprice").alias("revenue_usd"), F.count(F.lit(1)).alias("order_count")
    )


def attribution(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Conversions per segment: orders are counted per customer before they meet the customers."""
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("o_totalprice").cast("decimal(28,2)")).alias("_t"))
    return per.join(customer, per.o_custkey == customer.c_custkey).groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.sum("_n").alias("conversions"), F.count(F.lit(1)).alias("customers"), F.sum("_t").cast("double").alias("revenue")
    )


def orders_from_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ordered_at"), F.col("value").alias("amount")
    )
