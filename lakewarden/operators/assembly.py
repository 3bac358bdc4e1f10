"""Raw metadata events, enriched events, and the rows a catalog keeps of them.

One event describes the tables of one schema as one run found them. It travels in bounded messages that share its
id: a wide table is cut after every so many columns. Enrichment scores and classifies columns row by row, then gathers the
messages of an event again, so one enriched event goes out for one that came in. The same code serves batch and stream; in a
stream the gathering is keyed state that the watermark releases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions.scalars import asset_fqn, asset_id, grade_of, nearest, pick, readable, sensitivity_name
from .classification import classify
from .enrichment import column_description, winner
from .glossary import column_terms, table_terms
from .quality import score_columns, weighted

PARTS = ("completeness", "uniqueness", "validity", "consistency")
QUALITY = "struct<completeness: double, uniqueness: double, validity: double, consistency: double, overall: double, grade: string>"
ENRICHED_COLUMN = (
    "struct<name: string, data_type: string, description: string, is_nullable: boolean, pii_classification: string, pii_category: string, sensitivity_level: string, "
    f"suggested_terms: array<string>, quality_score: {QUALITY}, null_count: bigint, distinct_count: bigint, min_value: string, max_value: string, avg_value: double, "
    "sample_values: array<string>, tags: map<string, string>>"
)
ENRICHED_TABLE = (
    "struct<schema_name: string, table_name: string, fqn: string, description: string, domain: string, data_owner: string, data_steward: string, sensitivity_level: string, "
    f"columns: array<{ENRICHED_COLUMN}>, table_quality_score: {QUALITY}, row_count: bigint, size_bytes: bigint, suggested_terms: array<string>, tags: map<string, string>>"
)
ENRICHED_EVENT = (
    "event_id string, source_id string, source_type string, run_id string, database_name string, schema_name string, emitted_at timestamp, "
    f"tables array<{ENRICHED_TABLE}>, enriched_at timestamp"
)
_EVENT = ["emitted_at", "event_id", "source_id", "source_type", "run_id", "database_name", "schema_name"]
DEALT = "_dealt"
COLUMNS_PER_TASK = 50_000
_COLUMN = ("name", "data_type", "description", "is_nullable", "pii_classification", "pii_category", "sensitivity_level", "suggested_terms", "quality_score", "null_count", "distinct_count", "min_value", "max_value", "avg_value", "sample_values")


def enriched_schema(spark: SparkSession) -> T.StructType:
    return spark.createDataFrame([], ENRICHED_EVENT).schema


def _no_tags() -> Column:
    return F.create_map().cast("map<string, string>")


def _first(*keys: Column) -> Column:
    """A hash that leads the keys of a grouping: lists are gathered by sorting, and one number tells most groups apart where the keys share long beginnings."""
    return F.xxhash64(*keys).alias("_first")


def _dealt(df: DataFrame) -> list[str]:
    return [DEALT] if DEALT in df.columns else []


# ---- raw events -----------------------------------------------------------
def tasks_for(spark: SparkSession, n: int) -> int:
    """So many tasks that none holds much more than ``COLUMNS_PER_TASK`` of ``n`` columns."""
    return max(spark.sparkContext.defaultParallelism, -(-n // COLUMNS_PER_TASK))


def dealt(rows: DataFrame, n: int, keys: Sequence[str] = ("source_type", "schema_name", "table_name")) -> DataFrame:
    """Rows of a profile of about ``n`` columns, those of a table in one task, with the number they are dealt by (``DEALT``).

    What is made of them keeps the number and is grouped by it too: messages, enriched columns and enriched tables then need no shuffle
    of their own. Rows are sent once, and can be sent before the fields that widen them are known. A table ends as one row, so its columns
    meet in one task in any case.
    """
    return rows.withColumn(DEALT, F.xxhash64(*keys)).repartition(tasks_for(rows.sparkSession, n), DEALT)


def raw_events(profile: DataFrame, source_id: str, source_type: Column | str, database: str, run_id: str, emitted_at: str, schema: str = "schema_name", limit: int = 500) -> DataFrame:
    """Messages of one event per schema, as ``profiling.RAW_EVENT``, from one row per column of a profile.

    ``source_type`` is a text, or a column where the profile holds several sources: one pass makes the messages of all. A table's
    columns are cut after every ``limit``; ``column_offset`` says how many stand in earlier messages. Columns that the profile lacks are null.
    """
    have = set(profile.columns)
    field = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    column = F.struct(
        "ordinal", F.col("column_name").alias("name"), "data_type", F.coalesce(F.col("is_nullable") if "is_nullable" in have else F.lit(None), F.lit(True)).alias("is_nullable"),
        field("is_primary_key", "boolean"), field("is_foreign_key", "boolean"), field("max_length", "int"), field("precision", "int"), field("scale", "int"), field("description", "string"),
        "null_count", "distinct_count", field("min_value", "string"), field("max_value", "string"), field("avg_value", "double"), "sample_values",
    )
    part = F.floor((F.col("ordinal") - 1) / limit)
    source = source_type if isinstance(source_type, Column) else F.lit(source_type)
    tables = profile.groupBy(_first(source, F.col(schema), F.col("table_name"), part), *_dealt(profile), source.alias("_source"), F.col(schema).alias("schema_name"), "table_name", part.alias("_part")).agg(
        F.max("row_count").alias("row_count"), F.max(field("size_bytes", "bigint")).alias("size_bytes"), F.max(field("last_modified", "timestamp")).alias("last_modified"),
        F.sort_array(F.collect_list(column)).alias("columns"),
    )
    table = F.struct(
        "schema_name", "table_name", F.lit("TABLE").alias("table_type"), "row_count", "size_bytes", "last_modified", (F.col("_part") * limit).alias("column_offset"), "columns",
        F.transform(F.filter("columns", lambda c: F.coalesce(c.is_primary_key, F.lit(False))), lambda c: c["name"]).alias("primary_keys"), _no_tags().alias("tags"),
    )
    event_id = F.concat(F.lit("e-"), F.md5(F.concat_ws("#", F.lit(source_id), "schema_name", F.lit(run_id)).cast("binary")))
    return tables.select(
        event_id.alias("event_id"), F.lit(source_id).alias("source_id"), F.col("_source").alias("source_type"), F.lit(emitted_at).cast("timestamp").alias("emitted_at"),
        F.struct(F.lit(database).alias("database_name"), "schema_name", F.array(table).alias("tables")).alias("schema_profile"),
        F.lit("1.0.0").alias("connector_version"), F.lit(run_id).alias("run_id"), *_dealt(profile),
    )


# ---- enrichment -----------------------------------------------------------
def enriched_columns(events: DataFrame) -> DataFrame:
    """One row per column of every message, scored, classified and described; a table without columns is one row without a name."""
    tables = events.select(*_dealt(events), *_EVENT[:5], F.col("schema_profile.database_name").alias("database_name"), F.col("schema_profile.schema_name").alias("schema_name"), F.explode("schema_profile.tables").alias("t"))
    rows = tables.select(
        *_dealt(events), *_EVENT, F.coalesce("t.schema_name", "schema_name").alias("table_schema"), F.col("t.table_name").alias("table_name"), F.col("t.row_count").alias("row_count"), F.col("t.size_bytes").alias("size_bytes"), F.col("t.tags").alias("tags"),
        F.coalesce("t.column_offset", F.lit(0)).alias("_offset"), F.posexplode_outer("t.columns").alias("_at", "c"),
    ).select(
        "*", (F.col("_offset") + F.col("_at") + 1).alias("ordinal"), F.col("c.name").alias("column_name"), *[F.col(f"c.{x}").alias(x) for x in ("data_type", "null_count", "distinct_count", "min_value", "max_value", "avg_value")],
        F.coalesce("c.is_nullable", F.lit(True)).alias("is_nullable"), F.coalesce("c.sample_values", F.array().cast("array<string>")).alias("sample_values"), F.col("c.description").alias("raw_description"),
    ).drop("c", "_at", "_offset")
    return (
        classify(score_columns(rows)).withColumn("description", column_description("raw_description", "column_name", "data_type"))
        .withColumn("suggested_terms", column_terms("column_name")).withColumn("fqn", asset_fqn("source_type", "table_schema", "table_name")).drop("raw_description")
    )


def _domain(columns: Column) -> Column:
    """Domain of table and column names: most patterns found in the text of them all; ties to the first."""
    text = F.concat_ws(" ", F.lower("table_name"), F.array_join(F.transform(columns, lambda c: F.lower(c["name"])), " "))
    scores = {}
    for domain, patterns in vocab.DOMAIN_PATTERNS.items():
        score = F.lit(0)
        for pattern in patterns:
            score = score + text.rlike(pattern).cast("int")
        scores[domain] = score
    return winner(scores)


def enriched_tables(columns: DataFrame) -> DataFrame:
    """One row per event and table: its columns in order, and all that follows from them."""
    entry = F.struct(
        "ordinal", F.col("column_name").alias("name"), "data_type", "description", "is_nullable", F.col("classification").alias("pii_classification"), F.col("category").alias("pii_category"), "sensitivity_level",
        "suggested_terms", F.struct(*PARTS, "overall", "grade").alias("quality_score"), "null_count", "distinct_count", "min_value", "max_value", "avg_value", "sample_values",
    )
    named = F.col("column_name").isNotNull()
    rank = F.when(F.col("classification") == "PII", 3).when(F.col("classification") == "SENSITIVE", 2).otherwise(0)
    # scores have four decimals, so ten-thousandths are whole numbers and their sum does not hang on the order of rows
    mean = lambda p: F.coalesce(F.sum(F.when(named, F.round(F.col(p) * 10000.0).cast("bigint"))) / 10000.0 / F.count(F.when(named, F.col(p))), F.lit(0.0)).alias(f"_{p}")
    grouped = columns.groupBy(_first(F.col("event_id"), F.col("fqn")), *_dealt(columns), *_EVENT, "table_schema", "table_name", "fqn").agg(
        F.sort_array(F.collect_list(F.when(named, entry))).alias("_columns"), F.max("row_count").alias("row_count"), F.max("size_bytes").alias("size_bytes"),
        F.first("tags", ignorenulls=True).alias("tags"), F.max(F.when(named, rank)).alias("_rank"), *[mean(p) for p in PARTS],
    )
    overall = weighted(*[F.col(f"_{p}") for p in PARTS])
    names = F.array_join(F.slice(F.transform("_columns", lambda c: c["name"]), 1, 5), ", ")
    about = F.concat(
        readable("table_name"), F.lit(" contains records from the "), "table_schema", F.lit(" schema. Key columns include: "), names,
        F.lit(". Auto-generated — please enrich via the Data Catalog UI."),
    )
    listed = F.transform("_columns", lambda c: F.struct(*[c[f].alias(f) for f in _COLUMN], _no_tags().alias("tags")))
    nobody = F.lit(None).cast("string")
    return grouped.select(
        *_EVENT,
        F.struct(
            F.col("table_schema").alias("schema_name"), "table_name", "fqn", about.alias("description"), _domain(F.col("_columns")).alias("domain"), nobody.alias("data_owner"), nobody.alias("data_steward"),
            sensitivity_name(F.coalesce("_rank", F.lit(0))).alias("sensitivity_level"), listed.alias("columns"),
            F.struct(*[nearest(f"_{p}", 4).alias(p) for p in PARTS], nearest(overall, 4).alias("overall"), grade_of(overall).alias("grade")).alias("table_quality_score"),
            "row_count", "size_bytes", table_terms(F.col("table_name")).alias("suggested_terms"), F.coalesce("tags", _no_tags()).alias("tags"),
        ).alias("t"),
    )


def enriched_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One enriched event (``ENRICHED_EVENT``) per raw event, its messages gathered and its tables in order of their names.

    In a stream, in append mode, an event goes out once the watermark (``delay`` behind the newest ``emitted_at``) has passed it, and
    its state goes with it. A run therefore ends with a message without tables that carries the time of its end.
    """
    tables = enriched_tables(enriched_columns(events.withWatermark("emitted_at", delay)))
    by_name = lambda x, y: F.when(x["fqn"] < y["fqn"], -1).when(x["fqn"] > y["fqn"], 1).otherwise(0)
    return tables.groupBy(*_EVENT).agg(F.collect_list("t").alias("tables")).select(
        *[c for c in _EVENT if c != "emitted_at"], "emitted_at", F.array_sort("tables", by_name).alias("tables"), F.current_timestamp().alias("enriched_at")
    )


# ---- what a catalog keeps -------------------------------------------------
ASSET_FIXED = ("asset_id", "source_id", "source_type", "database_name", "schema_name", "table_name", "description", "domain", "data_owner", "data_steward", "tags", "is_active", "run_id", "ingested_at")
ASSET_MEASURED = (
    "sensitivity_level", "row_count", "size_bytes", "quality_score", "quality_grade", "quality_completeness", "quality_uniqueness", "quality_validity", "quality_consistency", "suggested_terms", "updated_at",
)
COLUMN_FIELDS = (
    "column_id", "asset_id", "asset_fqn", "column_name", "data_type", "description", "is_nullable", "pii_classification", "pii_category", "sensitivity_level", "suggested_terms", "quality_score", "quality_grade",
    "null_count", "distinct_count", "min_value", "max_value", "avg_value", "sample_values", "ingested_at",
)
STAMP = ("emitted_at", "stamp_run", "stamp_event")


def _stamped() -> list[Column]:
    return [F.col("emitted_at"), F.col("run_id").alias("stamp_run"), F.col("event_id").alias("stamp_event")]


def asset_rows(events: DataFrame) -> DataFrame:
    """fqn, the 25 other fields of an asset, and the stamp of the event, per table of every enriched event."""
    t = lambda path: F.col(f"t.{path}")
    tables = events.select("*", F.explode("tables").alias("t"))
    return tables.select(
        t("fqn").alias("fqn"), asset_id("t.fqn").alias("asset_id"), "source_id", "source_type", "database_name", t("schema_name").alias("schema_name"), t("table_name").alias("table_name"), t("description").alias("description"),
        t("domain").alias("domain"), t("data_owner").alias("data_owner"), t("data_steward").alias("data_steward"), F.coalesce(t("sensitivity_level"), F.lit("INTERNAL")).alias("sensitivity_level"), t("row_count").alias("row_count"),
        t("size_bytes").alias("size_bytes"), t("table_quality_score.overall").alias("quality_score"), t("table_quality_score.grade").alias("quality_grade"), *[t(f"table_quality_score.{p}").alias(f"quality_{p}") for p in PARTS],
        F.coalesce(t("tags"), _no_tags()).alias("tags"), F.coalesce(t("suggested_terms"), F.array().cast("array<string>")).alias("suggested_terms"), F.lit(True).alias("is_active"), "run_id",
        F.col("emitted_at").alias("ingested_at"), F.col("emitted_at").alias("updated_at"), *_stamped(),
    )


def column_rows(events: DataFrame) -> DataFrame:
    """fqn, the 20 other fields of a column, and the stamp of the event, per column of every enriched event."""
    c = lambda path: F.col(f"c.{path}")
    rows = events.select("emitted_at", "run_id", "event_id", F.explode("tables").alias("t")).select("emitted_at", "run_id", "event_id", F.col("t.fqn").alias("asset_fqn"), F.explode("t.columns").alias("c"))
    fqn = F.concat_ws(".", "asset_fqn", "c.name")
    return rows.select(
        fqn.alias("fqn"), F.concat(F.lit("column-"), F.substring(F.md5(fqn.cast("binary")), 1, 12)).alias("column_id"), asset_id("asset_fqn").alias("asset_id"), "asset_fqn", c("name").alias("column_name"),
        *[c(f).alias(f) for f in ("data_type", "description", "is_nullable", "pii_classification", "pii_category")], F.coalesce(c("sensitivity_level"), F.lit("PUBLIC")).alias("sensitivity_level"), c("suggested_terms").alias("suggested_terms"),
        c("quality_score.overall").alias("quality_score"), c("quality_score.grade").alias("quality_grade"), *[c(f).alias(f) for f in ("null_count", "distinct_count", "min_value", "max_value", "avg_value", "sample_values")],
        F.col("emitted_at").alias("ingested_at"), *_stamped(),
    )
