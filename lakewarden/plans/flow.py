"""The main flow: profile -> raw events -> enriched events -> catalog, and its steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, profiling
from ..session import scratch_dir, staged, use_utc
from ..sources import sinks
from ..sources.readers import LAKE_TABLES, lake
from ..streaming import catalog_flow, streams
from . import derived as d
from .governance import DOMAIN_SCORES_SQL, TABLE_TERMS_SQL, TERM_RANKS_SQL, title_sql
from .profiles import HYDRATE_SQL, INT_COLUMNS, SAMPLES_SQL, profiled
from .registry import query

_RUN, _EMITTED = "run-1", "2024-01-31T00:00:00Z"


def raw_topic(spark, root, limit: int = 4) -> str:
    """What a run over the lake's own tables emits: profile, samples and sizes of every column as bounded messages of one event, then the mark of its end."""
    path = scratch_dir(spark, "raw-metadata-events")
    tables = lake(use_utc(spark), root)
    profile, _ = profiling.hydrate(tables, samples=True)
    sizes = profiling.table_stats(spark, tables, with_files=True).select("table_name", "size_bytes", "last_modified")
    rows = profile.join(F.broadcast(sizes), "table_name").withColumn("schema_name", F.lit("lake")).withColumn("avg_value", F.round(F.round("avg_value", 10), 6))  # one row per table
    events = assembly.raw_events(rows, "lake", "sqlite", "lake", _RUN, _EMITTED, limit=limit)
    sinks.as_messages(events, F.col("event_id"), "raw-metadata-events").select("value").write.text(f"{path}/run")
    end = spark.range(1).select(F.lit("end-" + _RUN).alias("event_id"), F.lit("lake").alias("source_id"), F.lit("sqlite").alias("source_type"), F.lit("2024-01-31T01:00:00Z").alias("emitted_at"), F.lit(_RUN).alias("run_id"))
    end.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/run-end")
    return f"{path}/*"


def enriched_topic(spark, root) -> str:
    events, _ = streams.decoded(streams.read_json_lines(spark, raw_topic(spark, root)), profiling.RAW_EVENT)
    return catalog_flow.enrich_to_topic(events, scratch_dir(spark, "enriched"))


_KIND = {"n": "bigint", "r": "double", "t": "timestamp_ntz", "s": "string"}
_FIELDS_SQL = ", ".join(
    f"('{t}', '{c}', {i}, '{'int' if c in INT_COLUMNS else _KIND[k]}')" for t in LAKE_TABLES for i, (c, k) in enumerate(profiled(t), 1))
_LAKE_SQL = f"""fields AS (SELECT * FROM (VALUES {_FIELDS_SQL}) AS t(table_name, column_name, ordinal, data_type)), profile AS ({HYDRATE_SQL}),
    samples AS (SELECT table_name, column_name, list(value ORDER BY rank) AS sample_values FROM ({SAMPLES_SQL}) GROUP BY 1, 2),
    cat_columns AS (SELECT 'sqlite' AS source_type, 'lake' AS schema_name, 'sqlite.lake.' || f.table_name AS asset_fqn, f.*, p.row_count, p.null_count, p.distinct_count, p.min_value, p.max_value, p.avg_value, coalesce(s.sample_values, CAST([] AS VARCHAR[])) AS sample_values
        FROM fields f JOIN profile p USING (table_name, column_name) LEFT JOIN samples s USING (table_name, column_name))"""
_TERMS_SQL = TERM_RANKS_SQL.replace("WITH ", "", 1).replace("scored AS", "term_scored AS").replace("FROM scored", "FROM term_scored")
_CLASS_SQL = ", ".join(f"{n} AS ({d.CTES[n][1]})" for n in ("kinds", "rules", "kind_class", "parts", "scored"))
_TABLES_SQL = f"""
    means AS (SELECT asset_fqn, any_value(source_type) AS source_type, any_value(schema_name) AS schema_name, any_value(table_name) AS table_name, any_value(row_count) AS row_count, count(*) AS column_count,
        lower(any_value(table_name)) || ' ' || string_agg(lower(column_name), ' ' ORDER BY ordinal, column_name) AS txt, array_to_string(list(column_name ORDER BY ordinal, column_name)[1:5], ', ') AS first_names,
        count(*) FILTER (WHERE pii_classification = 'PII') AS pii, count(DISTINCT column_name) AS names, max(CASE pii_classification WHEN 'PII' THEN 3 WHEN 'SENSITIVE' THEN 2 ELSE 0 END) AS level_rank,
        {", ".join(f"CAST(sum(CAST({x} AS DECIMAL(28, 4))) AS DOUBLE) / count(*) AS m_{x}" for x in assembly.PARTS)} FROM cols GROUP BY 1),
    weighted AS (SELECT *, m_completeness * 0.35::DOUBLE + m_uniqueness * 0.25::DOUBLE + m_validity * 0.25::DOUBLE + m_consistency * 0.15::DOUBLE AS m_overall FROM means),
    domain_scores AS (SELECT asset_fqn, v.* FROM means, LATERAL (VALUES {DOMAIN_SCORES_SQL}) AS v(ord, domain, score)),
    domain_of AS (SELECT asset_fqn, arg_max(domain, (score, -ord)) AS domain FROM domain_scores WHERE score > 0 GROUP BY 1),
    tabs AS (SELECT w.asset_fqn AS fqn, source_type, schema_name, table_name, row_count, column_count, pii, names,
        {title_sql("table_name")} || ' contains records from the ' || schema_name || ' schema. Key columns include: ' || first_names || '. Auto-generated — please enrich via the Data Catalog UI.' AS description,
        d.domain, ['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'RESTRICTED'][level_rank + 1] AS sensitivity_level, {", ".join(f"nearest(m_{x}, 4) AS quality_{x}" for x in assembly.PARTS)}, nearest(m_overall, 4) AS quality_score,
        {d.grade_sql("m_overall")} AS quality_grade, array_to_string(list_sort({TABLE_TERMS_SQL}), ',') AS suggested_terms FROM weighted w LEFT JOIN domain_of d USING (asset_fqn))"""
_ENRICHED_SQL = f"""WITH {_LAKE_SQL}, {_CLASS_SQL}, {_TERMS_SQL},
    terms_of AS (SELECT column_name, string_agg(term, ',' ORDER BY rank) AS suggested_terms FROM ranked WHERE rank <= 5 GROUP BY 1),
    cols AS (SELECT c.*, k.classification AS pii_classification, k.category AS pii_category, k.sensitivity_level, coalesce(t.suggested_terms, '') AS suggested_terms,
        'The ' || {title_sql("c.column_name")} || ' field (' || c.data_type || '). Auto-generated — please review.' AS description
        FROM scored c JOIN kind_class k ON k.column_name = c.column_name AND k.sample_values = c.sample_values LEFT JOIN terms_of t ON t.column_name = c.column_name),
    {_TABLES_SQL}"""


@query("k1_enrichment_stream", f"""{_ENRICHED_SQL}
    SELECT 'e-' || md5('lake#lake#run-1') AS event_id, 'run-1' AS run_id, t.fqn, t.table_name, t.description, t.domain, t.sensitivity_level, t.row_count, true AS has_size, t.suggested_terms, 0 AS tags,
        t.quality_completeness, t.quality_uniqueness, t.quality_validity, t.quality_consistency, t.quality_score, t.quality_grade,
        c.ordinal, c.column_name, c.data_type, c.description AS column_description, true AS is_nullable, c.pii_classification, c.pii_category, c.sensitivity_level AS column_level, c.suggested_terms AS column_terms,
        c.completeness, c.uniqueness, c.validity, c.consistency, c.overall, c.grade, c.null_count, c.distinct_count, c.min_value, c.max_value, c.avg_value, c.sample_values
    FROM tabs t JOIN cols c ON c.asset_fqn = t.fqn""")
def k1(spark, root):
    """Every field of the enriched event that the run over the lake's tables becomes, by the stream; one row per column."""
    out = spark.read.text(f"{enriched_topic(spark, root)}/*").select(F.from_json("value", assembly.ENRICHED_EVENT).alias("e")).select("e.*")
    t, c = (lambda x: F.col(f"t.{x}")), (lambda x: F.col(f"c.{x}"))
    tables = out.select("event_id", "run_id", F.explode("tables").alias("t")).select("*", F.posexplode("t.columns").alias("at", "c"))
    return tables.select(
        "event_id", "run_id", t("fqn"), t("table_name"), t("description"), t("domain"), t("sensitivity_level"), t("row_count"), (t("size_bytes") > 0).alias("has_size"), F.array_join(F.sort_array(t("suggested_terms")), ",").alias("suggested_terms"), F.size(t("tags")).alias("tags"),
        *[t(f"table_quality_score.{x}").alias(f"quality_{x}") for x in assembly.PARTS], t("table_quality_score.overall").alias("quality_score"), t("table_quality_score.grade").alias("quality_grade"),
        (F.col("at") + 1).alias("ordinal"), c("name").alias("column_name"), c("data_type"), c("description").alias("column_description"), c("is_nullable"), c("pii_classification"), c("pii_category"), c("sensitivity_level").alias("column_level"),
        F.array_join(c("suggested_terms"), ",").alias("column_terms"), *[c(f"quality_score.{x}").alias(x) for x in (*assembly.PARTS, "overall", "grade")], c("null_count"), c("distinct_count"), c("min_value"), c("max_value"), c("avg_value"), c("sample_values"),
    )


@query("k2_catalog_ingest", f"""{_ENRICHED_SQL}
    SELECT fqn, 'asset-' || substr(md5(fqn), 1, 12) AS asset_id, 'lake' AS source_id, 'sqlite' AS source_type, 'lake' AS database_name, 'lake' AS schema_name, table_name, description, domain, CAST(NULL AS VARCHAR) AS data_owner, CAST(NULL AS VARCHAR) AS data_steward,
        sensitivity_level, row_count, true AS has_size, quality_score, quality_grade, quality_completeness, quality_uniqueness, quality_validity, quality_consistency, 0 AS tags, suggested_terms, true AS is_active, 'run-1' AS run_id,
        '2024-01-31 00:00:00' AS ingested_at, '2024-01-31 00:00:00' AS updated_at,
        (SELECT count(*) FROM cols c WHERE c.asset_fqn = fqn) AS column_count, (SELECT string_agg('column-' || substr(md5(fqn || '.' || column_name), 1, 12) || ':' || column_name || ':' || data_type || ':' || sensitivity_level || ':' || coalesce(pii_category, '-') || ':' || grade || ':' || distinct_count || ':' || coalesce(max_value, '-'), ' ' ORDER BY column_name) FROM cols c WHERE c.asset_fqn = fqn) AS columns
    FROM tabs""")
def k2(spark, root):
    """The run over the lake's tables through both streams into the catalog: all fields of assets, and their columns."""
    events, _ = streams.decoded(streams.read_json_lines(spark, f"{enriched_topic(spark, root)}/*", max_files=4), assembly.enriched_schema(spark))
    store = catalog_flow.CatalogIngest(spark).run(events)
    item = F.concat_ws(":", "column_id", "column_name", "data_type", "sensitivity_level", F.coalesce("pii_category", F.lit("-")), "quality_grade", "distinct_count", F.coalesce("max_value", F.lit("-")))
    columns = store.columns().groupBy("asset_fqn").agg(F.count(F.lit(1)).alias("column_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_name", item.alias("item")))), lambda x: x["item"]), " ").alias("columns"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return store.assets().join(columns, F.col("fqn") == F.col("asset_fqn"), "left").select(
        "fqn", *[c for c in assembly.ASSET_FIXED if c not in ("tags", "ingested_at")], "sensitivity_level", "row_count", (F.col("size_bytes") > 0).alias("has_size"), "quality_score", "quality_grade", *[f"quality_{x}" for x in assembly.PARTS],
        F.size("tags").alias("tags"), F.array_join(F.sort_array("suggested_terms"), ",").alias("suggested_terms"), shown("ingested_at"), shown("updated_at"), "column_count", "columns",
    )


@query("f8_flattened_events", d.with_ctes(f"""
    WITH cols AS (SELECT c.*, k.classification AS pii_classification FROM scored c JOIN kind_class k ON k.column_name = c.column_name AND k.sample_values = c.sample_values), {_TABLES_SQL}
    SELECT fqn, 'asset-' || substr(md5(fqn), 1, 12) AS asset_id, source_type, schema_name, table_name, description, domain, sensitivity_level, row_count, quality_score, quality_grade,
        quality_completeness, quality_uniqueness, quality_validity, quality_consistency, suggested_terms, column_count, pii, names FROM tabs""", "scored", "kind_class"))
def f8(spark, root):
    """Enriched tables flattened to the rows of a catalog; the columns of a table come in bounded messages.

    Enriched tables are written once: the rows of assets and those of columns each read the fields they need.
    """
    lines = d.table(spark, root, "lineitem").count()
    c = d.columns(spark, root, lambda rows: assembly.dealt(rows, lines))
    raw = assembly.raw_events(c.filter(F.col("source_type").isin(*d.CAT_SOURCES)), "lake", F.col("source_type"), "lake", _RUN, _EMITTED)
    tables = assembly.enriched_tables(assembly.enriched_columns(raw))
    events = staged(tables.withColumn("tables", F.array("t")).drop("t"), "enriched-tables")
    per = assembly.column_rows(events).repartition(assembly.tasks_for(spark, lines), "asset_id").groupBy("asset_id").agg(F.count(F.lit(1)).alias("column_count"), F.count_if(F.col("pii_classification") == "PII").alias("pii"), F.count_distinct("fqn").alias("names"))
    return assembly.asset_rows(events).join(per, "asset_id").select(
        "fqn", "asset_id", "source_type", "schema_name", "table_name", "description", "domain", "sensitivity_level", "row_count", "quality_score", "quality_grade", *[f"quality_{x}" for x in assembly.PARTS],
        F.array_join(F.sort_array("suggested_terms"), ",").alias("suggested_terms"), "column_count", "pii", "names",
    )
