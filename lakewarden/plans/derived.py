"""Governance tables derived from the lake's own tables, in Spark and as SQL.

assets from ``part``, columns from ``lineitem``, audit log, requests and metrics from
``events``, lineage edges from ``lineitem`` and ``orders``. Every row comes from a row of
the lake, so the work of a query grows with the data. The SQL in ``CTES`` states the same
derivation independently for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import asset_fqn, asset_id, grade_of, pick
from ..session import use_utc
from ..sources.readers import lake_table
from .sample_columns import COLUMNS

# Fixed values of the derivation.
CAT_SOURCES = ("teradata", "mssql", "bigquery", "sqlite", "postgresql")
CAT_TABLE_WORDS = ("customer", "order", "product", "employee", "account", "invoice", "event")
CAT_DOMAINS = {"ECONOMY": "finance", "LARGE": "operations", "MEDIUM": "product", "PROMO": "customer", "SMALL": "hr"}
EVENT_TYPES = {"view": "ASSET_READ", "click": "COLUMN_READ", "purchase": "PII_ACCESS", "signup": "USER_CREATED", "error": "LOGIN_FAILED"}
SERVICES = ("auth-service", "catalog-service", "connector-service", "term-service")
REQUEST_ROLES = (*vocab.ROLES, "guest")
REQUEST_RESOURCES = ("asset", "column", "term", "source", "user", "audit", "lineage", "classification", "unknown")
REQUEST_ACTIONS = ("read", "write", "delete", "read_sensitive", "read_pii", "read_pii_value", "hydrate", "override")
AS_OF = "2024-01-31"


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return lake_table(use_utc(spark), root, name)


def assets(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    brand_no = F.substring("p_brand", 7, 3).cast("int")
    domain_map = F.create_map(*[F.lit(x) for kv in CAT_DOMAINS.items() for x in kv])
    rows = (key * 7919) % 2000000 + 1
    score = size / F.lit(50.0)
    base = p.select(
        key.alias("asset_key"), pick(CAT_SOURCES, brand_no % 5).alias("source_type"), F.col("p_type").alias("schema_name"),
        F.concat(pick(CAT_TABLE_WORDS, size % 7), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key).alias("table_name"),
        F.lit("lake").alias("database_name"), F.col("p_brand").alias("source_id"),
        F.when(size % 5 == 1, "n/a").when(size % 5 == 2, " TBD ").when(size % 5 == 3, "").when(size % 5 == 4, F.concat(F.lit("Holds "), "p_name")).alias("description"),
        F.try_element_at(domain_map, F.col("p_type")).alias("domain"),
        F.concat(F.lit("owner"), key % 17, F.lit("@example.com")).alias("data_owner"),
        F.concat(F.lit("steward"), key % 11, F.lit("@example.com")).alias("data_steward"),
        pick(vocab.SENSITIVITY, size % 4).alias("sensitivity_level"),
        rows.alias("row_count"), (rows * (size * 10 + 16)).alias("size_bytes"),
        score.alias("quality_score"), grade_of(score).alias("quality_grade"),
        F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))).alias("tags"),
        (size % 10 != 0).alias("is_active"), F.concat(F.lit("run-"), key % 13).alias("run_id"),
        (F.lit("2023-06-01").cast("timestamp_ntz") + F.make_dt_interval((key % 300).cast("int"))).alias("ingested_at"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), key.cast("int"))).alias("updated_at"),
    )
    out = base.withColumn("fqn", asset_fqn("source_type", "schema_name", "table_name"))
    return out.withColumn("asset_id", asset_id("fqn"))


def sample_columns(spark: SparkSession) -> DataFrame:
    rows = [(i, c[1], c[2], c[3], list(c[6])) for i, c in enumerate(COLUMNS)]
    return spark.createDataFrame(rows, "idx bigint, sample_name string, data_type string, is_nullable boolean, samples array<string>")


def columns(spark: SparkSession, root: str, early: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One column row per line item: name, type and samples by position, counts from its measures.

    Line items meet their assets while they are narrow. ``early`` is applied to them then, before names, types and samples join them; columns that it adds are kept.
    """
    li = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_quantity")
    line = F.col("l_linenumber")
    a = assets(spark, root).select("asset_key", "asset_id", F.col("fqn").alias("asset_fqn"), "source_type", "schema_name", "table_name", "row_count")
    with_asset = li.join(a, F.col("l_partkey") == F.col("asset_key"))
    narrow = with_asset if early is None else early(with_asset)
    added = [c for c in narrow.columns if c not in with_asset.columns]
    # 68 rows of fixed size
    joined = narrow.withColumn("idx", (F.col("l_orderkey") * 7 + line) % len(COLUMNS)).join(F.broadcast(sample_columns(spark)), "idx")
    name = (
        F.when(line == 5, F.replace(F.initcap(F.replace("sample_name", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")))
        .when(line == 6, F.concat(F.lit("private_"), F.lower("sample_name")))
        .otherwise(F.col("sample_name"))
    )
    samples = (
        F.when(line == 7, F.array().cast("array<string>"))
        .when((F.col("sample_name") == "CARD_NUMBER") & (line % 2 == 0), F.array(F.lit("4111-1111-1111-1111")))
        .otherwise(F.col("samples"))
    )
    rows = F.col("row_count")
    counted = joined.withColumn("null_count", F.floor(rows * F.col("l_tax") * 5.0).cast("bigint"))
    return counted.select(
        "asset_key", "asset_id", "asset_fqn", "source_type", "schema_name", "table_name", "row_count",
        (F.col("l_orderkey") * 8 + line).alias("ordinal"), name.alias("column_name"), "data_type", "is_nullable",
        samples.alias("sample_values"), "null_count",
        F.floor((rows - F.col("null_count")) * F.col("l_quantity") / 50.0).cast("bigint").alias("distinct_count"),
        F.when(line == 2, "N/A ").when(line == 3, "tbd").when(line > 3, F.concat(F.lit("Column "), "sample_name")).alias("description"),
        F.col("l_quantity").alias("_quantity"), line.alias("line"), *added,
    )


def payload_k(column: str = "props"):
    return F.get_json_object(column, "$.k").cast("int")


def audit(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    types = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    user = F.col("user_id")
    return e.select(
        F.concat(F.lit("a-"), "event_id").alias("audit_id"), F.col("ts").alias("timestamp"), F.try_element_at(types, F.col("event_type")).alias("event_type"),
        F.concat(F.lit("u"), user).alias("user_id"), F.concat(F.lit("user"), user, F.lit("@example.com")).alias("user_email"),
        pick(vocab.ROLES, user % 4).alias("user_role"), F.concat(F.lit("10.0."), user % 7, F.lit("."), user % 11).alias("source_ip"),
        pick(SERVICES, F.col("event_id") % 4).alias("service"), F.lit("ASSET").alias("resource_type"), F.concat(F.lit("r"), F.col("event_id") % 97).alias("resource_id"),
        F.concat(F.lit("postgresql.public.table_"), F.col("event_id") % 97).alias("resource_fqn"), F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "FAILURE").when(F.col("event_id") % 10 == 0, "DENIED").otherwise("SUCCESS").alias("outcome"),
        F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("changes"),
        F.col("props").alias("metadata"),
    )


def requests(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("k", payload_k())
    eid, user, k, value = F.col("event_id"), F.col("user_id"), F.col("k"), F.col("value")
    level = F.floor(eid / 9) % 5
    return e.select(
        "event_id", pick(REQUEST_ROLES, user % 5).alias("role"), pick(REQUEST_RESOURCES, eid % 9).alias("resource"), pick(REQUEST_ACTIONS, k % 8).alias("action"),
        F.when(value < 2, True).when(value < 4, False).alias("blocked"), F.when(k % 10 == 7, True).when(k % 10 == 3, False).alias("emergency_access"),
        F.when(k % 3 != 0, F.concat(F.lit("u"), eid % 10)).alias("asset_steward"), F.when(k % 4 == 0, F.concat(F.lit("u"), eid % 6)).alias("asset_owner"),
        F.concat(F.lit("u"), user % 10).alias("user_email"), F.when(k % 6 == 0, "").when(k % 6 == 1, "ticket 42").alias("justification"),
        F.when(level < 4, pick(vocab.SENSITIVITY, F.least(level, F.lit(3)))).alias("sensitivity_level"),
    )


def events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events")


def raw_edges(spark: SparkSession, root: str) -> DataFrame:
    """Lineage edges as recorded, copies included: supplier -> part -> order -> customer."""
    li, o = table(spark, root, "lineitem"), table(spark, root, "orders")
    sup, prt = F.concat(F.lit("supplier.s"), "l_suppkey"), F.concat(F.lit("part.p"), "l_partkey")
    order_l, order_o = F.concat(F.lit("orders.o"), "l_orderkey"), F.concat(F.lit("orders.o"), "o_orderkey")
    eid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    def edge(edge_id, source, target, source_platform, target_platform, relationship, at, job):
        return F.struct(
            edge_id.alias("edge_id"), source.alias("source_fqn"), target.alias("target_fqn"), F.lit(source_platform).alias("source_platform"),
            F.lit(target_platform).alias("target_platform"), F.lit(relationship).alias("relationship"), at.alias("created_at"), job.alias("job_name"),
        )

    lines = li.select(F.inline(F.array(
        edge(F.concat(F.lit("sp-"), eid), sup, prt, "supplier", "part", "SUPPLIES", F.col("l_shipdate"), F.concat(F.lit("supply_"), F.col("l_suppkey") % 12)),
        edge(F.concat(F.lit("po-"), eid), prt, order_l, "part", "orders", "CONTAINS", F.col("l_shipdate"), F.concat(F.lit("order_"), F.col("l_partkey") % 12)),
    )))
    placed = o.select(F.inline(F.array(
        edge(F.concat(F.lit("oc-"), "o_orderkey"), order_o, F.concat(F.lit("customer.c"), "o_custkey"), "orders", "customer", "PLACED_BY", F.col("o_orderdate"), F.concat(F.lit("place_"), F.col("o_orderkey") % 12)),
    )))
    return lines.unionByName(placed)


_PLATFORMS = ("customer", "orders", "part", "supplier")  # in order of the alphabet


def edges(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (source, target) pairs; copies collapse map-side, with platforms as numbers: the least text would need a sort."""
    least = lambda c: F.min(F.array_position(F.array(*[F.lit(x) for x in _PLATFORMS]), F.col(c)).cast("int")).alias(c)
    found = raw_edges(spark, root).groupBy("source_fqn", "target_fqn").agg(least("source_platform"), least("target_platform"))
    return found.select("source_fqn", "target_fqn", *[pick(_PLATFORMS, F.col(c) - 1).alias(c) for c in ("source_platform", "target_platform")])


def nested_edges(spark: SparkSession, root: str) -> DataFrame:
    """Supplier -> part edges with one column mapping per l_linenumber step."""
    li = table(spark, root, "lineitem")
    step = lambda i: F.struct(
        F.concat(F.lit("c"), (F.col("l_orderkey") + i) % 23).alias("source_column"), F.concat(F.lit("t"), (F.col("l_partkey") + i) % 19).alias("target_column"),
        pick(("DIRECT", "DERIVED", "AGGREGATED"), (F.col("l_suppkey") + i) % 3).alias("transform_type"),
    )
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"), F.concat(F.lit("supplier.s"), "l_suppkey").alias("source_fqn"),
        F.concat(F.lit("part.p"), "l_partkey").alias("target_fqn"), F.concat(F.lit("supply_"), F.col("l_suppkey") % 12).alias("job_name"),
        F.transform(F.sequence(F.lit(0), (F.col("l_linenumber") % 3).cast("int")), step).alias("column_mappings"),
    ).dropDuplicates(["edge_id"])


# ---------------------------------------------------------------------------
# SQL
# ---------------------------------------------------------------------------
def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def sql_case(column: str, mapping: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + f" ELSE {default} END"


def grade_sql(expr: str) -> str:
    return f"CASE WHEN {expr} >= 0.9 THEN 'A' WHEN {expr} >= 0.75 THEN 'B' WHEN {expr} >= 0.6 THEN 'C' WHEN {expr} >= 0.4 THEN 'D' ELSE 'F' END"


def luhn_sql(expr: str) -> str:
    d = f"regexp_replace({expr}, '[^0-9]', '', 'g')"
    doubled = f"[CAST(substr(reverse({d}), CAST(i AS INT) + 1, 1) AS INT) * CAST(1 + i % 2 AS INT) for i in range(length({d}))]"
    return f"(length({d}) >= 13 AND list_sum([y - CASE WHEN y > 9 THEN 9 ELSE 0 END for y in {doubled}]) % 10 = 0)"


def rules_sql(rules) -> str:
    return "VALUES " + ", ".join(f"({i}, {q(r.name_re)}, {q(r.value_re)}, {q(r.category)}, {q(r.level)}, {vocab.SENSITIVITY.index(r.level)})" for i, r in enumerate(rules))


# name -> (names it needs, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "cat_assets": ((), f"""
        SELECT *, source_type || '.' || schema_name || '.' || table_name AS fqn,
               'asset-' || substr(md5(source_type || '.' || schema_name || '.' || table_name), 1, 12) AS asset_id
        FROM (SELECT p_partkey AS asset_key, {sql_list(CAT_SOURCES)}[CAST(substr(p_brand, 7) AS INT) % 5 + 1] AS source_type,
               p_type AS schema_name, {sql_list(CAT_TABLE_WORDS)}[p_size % 7 + 1] || '_' || replace(p_name, ' ', '_') || '_' || p_partkey AS table_name,
               'lake' AS database_name, p_brand AS source_id,
               CASE p_size % 5 WHEN 1 THEN 'n/a' WHEN 2 THEN ' TBD ' WHEN 3 THEN '' WHEN 4 THEN 'Holds ' || p_name END AS description,
               {sql_case("p_type", CAT_DOMAINS)} AS domain,
               'owner' || (p_partkey % 17) || '@example.com' AS data_owner, 'steward' || (p_partkey % 11) || '@example.com' AS data_steward,
               {sql_list(vocab.SENSITIVITY)}[p_size % 4 + 1] AS sensitivity_level,
               (p_partkey * 7919) % 2000000 + 1 AS row_count, ((p_partkey * 7919) % 2000000 + 1) * (p_size * 10 + 16) AS size_bytes,
               p_size / 50.0::DOUBLE AS quality_score, {grade_sql("p_size / 50.0::DOUBLE")} AS quality_grade,
               '{{"brand":"' || p_brand || '","type":"' || p_type || '"}}' AS tags, p_size % 10 <> 0 AS is_active, 'run-' || (p_partkey % 13) AS run_id,
               TIMESTAMP '2023-06-01' + to_days(CAST(p_partkey % 300 AS INT)) AS ingested_at, TIMESTAMP '2024-01-01' + to_minutes(p_partkey) AS updated_at
        FROM part)"""),
    "sample_columns": ((), "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {q(c[1])}, {q(c[2])}, {str(c[3]).lower()}, {sql_list(c[6])})" for i, c in enumerate(COLUMNS)
    ) + ") AS t(idx, sample_name, data_type, is_nullable, samples)"),
    "cat_columns": (("cat_assets", "sample_columns"), f"""
        SELECT *, CAST(floor((row_count - null_count) * _quantity / 50.0::DOUBLE) AS BIGINT) AS distinct_count FROM (
        SELECT a.asset_key, a.asset_id, a.fqn AS asset_fqn, a.source_type, a.schema_name, a.table_name, a.row_count,
               l_orderkey * 8 + l_linenumber AS ordinal, l_linenumber AS line, l_quantity AS _quantity,
               CASE WHEN l_linenumber = 5 THEN array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(s.sample_name, '_')], '')
                    WHEN l_linenumber = 6 THEN 'private_' || lower(s.sample_name) ELSE s.sample_name END AS column_name,
               s.data_type, s.is_nullable,
               CASE WHEN l_linenumber = 7 THEN CAST([] AS VARCHAR[]) WHEN s.sample_name = 'CARD_NUMBER' AND l_linenumber % 2 = 0 THEN ['4111-1111-1111-1111'] ELSE s.samples END AS sample_values,
               CAST(floor(a.row_count * l_tax * 5.0::DOUBLE) AS BIGINT) AS null_count,
               CASE WHEN l_linenumber = 2 THEN 'N/A ' WHEN l_linenumber = 3 THEN 'tbd' WHEN l_linenumber > 3 THEN 'Column ' || s.sample_name END AS description
        FROM lineitem JOIN sample_columns s ON s.idx = (l_orderkey * 7 + l_linenumber) % {len(COLUMNS)}
        JOIN cat_assets a ON a.asset_key = l_partkey)"""),
    "kinds": (("cat_columns",), "SELECT DISTINCT column_name, sample_values FROM cat_columns"),
    "rules": ((), f"SELECT * FROM ({rules_sql(vocab.SERVICE_RULES)}) AS t(ord, name_re, value_re, category, lvl, lvl_rank)"),
    "kind_class": (("kinds", "rules"), f"""
        SELECT k.column_name, k.sample_values, b.category,
               CASE WHEN b.lvl IN ('CONFIDENTIAL', 'RESTRICTED') THEN 'PII' WHEN b.lvl IS NOT NULL THEN 'SENSITIVE'
                    WHEN {" OR ".join(f"contains(lower(k.column_name), {q(w)})" for w in vocab.FALLBACK_WORDS)} THEN 'SENSITIVE' END AS classification,
               CASE WHEN b.lvl IS NOT NULL THEN b.lvl
                    WHEN {" OR ".join(f"contains(lower(k.column_name), {q(w)})" for w in vocab.FALLBACK_WORDS)} THEN 'INTERNAL' ELSE 'PUBLIC' END AS sensitivity_level
        FROM kinds k LEFT JOIN (
          SELECT column_name, sample_values, category, lvl FROM (
            SELECT k.column_name, k.sample_values, r.category, r.lvl,
                   row_number() OVER (PARTITION BY k.column_name, k.sample_values ORDER BY r.lvl_rank DESC, r.ord) AS rn
            FROM kinds k JOIN rules r ON regexp_matches(lower(k.column_name), r.name_re)
            WHERE (r.value_re IS NULL OR len(k.sample_values) = 0 OR len([v for v in k.sample_values if v <> '' and regexp_matches(v, r.value_re)]) > 0)
              AND (r.category <> 'CREDIT_CARD' OR len(k.sample_values) = 0 OR len([v for v in k.sample_values if {luhn_sql("v")}]) > 0)
          ) WHERE rn = 1) b ON b.column_name = k.column_name AND b.sample_values = k.sample_values"""),
    "classified": (("cat_columns", "kind_class"), """
        SELECT c.*, k.category, k.classification, k.sensitivity_level FROM cat_columns c
        JOIN kind_class k ON k.column_name = c.column_name AND k.sample_values = c.sample_values"""),
    "parts": (("cat_columns",), """
        SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - null_count / greatest(row_count, 1))) AS c_,
               least(1.0::DOUBLE, distinct_count / greatest(row_count - null_count, 1)) AS u_ FROM cat_columns"""),
    "scored": (("parts",), f"""
        SELECT *, nearest(c_, 4) AS completeness, nearest(u_, 4) AS uniqueness, 1.0::DOUBLE AS validity, 1.0::DOUBLE AS consistency,
               nearest(o_, 4) AS overall, {grade_sql("o_")} AS grade
        FROM (SELECT *, c_ * 0.35::DOUBLE + u_ * 0.25::DOUBLE + 0.25::DOUBLE + 0.15::DOUBLE AS o_ FROM parts)"""),
    "cat_audit": ((), f"""
        SELECT 'a-' || event_id AS audit_id, ts AS "timestamp", {sql_case("event_type", EVENT_TYPES)} AS event_type, 'u' || user_id AS user_id,
               'user' || user_id || '@example.com' AS user_email, {sql_list(vocab.ROLES)}[user_id % 4 + 1] AS user_role,
               '10.0.' || (user_id % 7) || '.' || (user_id % 11) AS source_ip, {sql_list(SERVICES)}[event_id % 4 + 1] AS service,
               'ASSET' AS resource_type, 'r' || (event_id % 97) AS resource_id, 'postgresql.public.table_' || (event_id % 97) AS resource_fqn, event_type AS action,
               CASE WHEN event_type = 'error' THEN 'FAILURE' WHEN event_id % 10 = 0 THEN 'DENIED' ELSE 'SUCCESS' END AS outcome, props AS metadata
        FROM events"""),
    "requests": ((), f"""
        SELECT event_id, {sql_list(REQUEST_ROLES)}[user_id % 5 + 1] AS role, {sql_list(REQUEST_RESOURCES)}[event_id % 9 + 1] AS resource,
               {sql_list(REQUEST_ACTIONS)}[k % 8 + 1] AS action, CASE WHEN value < 2 THEN true WHEN value < 4 THEN false END AS blocked,
               CASE k % 10 WHEN 7 THEN true WHEN 3 THEN false END AS emergency_access, CASE WHEN k % 3 <> 0 THEN 'u' || (event_id % 10) END AS asset_steward,
               CASE WHEN k % 4 = 0 THEN 'u' || (event_id % 6) END AS asset_owner, 'u' || (user_id % 10) AS user_email,
               CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'ticket 42' END AS justification, {sql_list((*vocab.SENSITIVITY, None)).replace("None", "NULL")}[(event_id // 9) % 5 + 1] AS sensitivity_level
        FROM (SELECT *, CAST(props ->> '$.k' AS INT) AS k FROM events)"""),
    "raw_edges": ((), """
        SELECT 'sp-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id, 'supplier.s' || l_suppkey AS source_fqn, 'part.p' || l_partkey AS target_fqn,
               'supplier' AS source_platform, 'part' AS target_platform, 'SUPPLIES' AS relationship, l_shipdate AS created_at, 'supply_' || (l_suppkey % 12) AS job_name FROM lineitem
        UNION ALL SELECT 'po-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'part.p' || l_partkey, 'orders.o' || l_orderkey, 'part', 'orders', 'CONTAINS', l_shipdate, 'order_' || (l_partkey % 12) FROM lineitem
        UNION ALL SELECT 'oc-' || o_orderkey, 'orders.o' || o_orderkey, 'customer.c' || o_custkey, 'orders', 'customer', 'PLACED_BY', o_orderdate, 'place_' || (o_orderkey % 12) FROM orders"""),
    "edges": (("raw_edges",), "SELECT DISTINCT source_fqn, target_fqn, source_platform, target_platform FROM raw_edges"),
    "nested_edges": ((), """
        SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id, 'supplier.s' || l_suppkey AS source_fqn, 'part.p' || l_partkey AS target_fqn,
               'supply_' || (l_suppkey % 12) AS job_name, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem"""),
    "mappings": (("nested_edges",), """
        SELECT edge_id, job_name, source_fqn, target_fqn, CAST(i AS INT) AS position, 'c' || ((l_orderkey + i) % 23) AS source_column, 't' || ((l_partkey + i) % 19) AS target_column,
               ['DIRECT', 'DERIVED', 'AGGREGATED'][(l_suppkey + i) % 3 + 1] AS transform_type
        FROM (SELECT *, unnest(range(l_linenumber % 3 + 1)) AS i FROM nested_edges)"""),
}


def with_ctes(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` preceded by the named derivations and what they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    lead = "WITH RECURSIVE " if recursive else "WITH "
    text = body.lstrip()
    if text.upper().startswith("WITH "):
        text = text[5:].lstrip()
        if text.upper().startswith("RECURSIVE "):
            text, lead = text[10:].lstrip(), "WITH RECURSIVE "
        return lead + ", ".join([*parts, text])
    return (lead + ", ".join(parts) + " " if parts else "") + text
