"""Queries over the lineage graph of the lake: supplier -> part -> order -> customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage
from ..operators.classification import classify
from ..session import scratch_dir, use_utc
from . import derived as d
from .registry import query

_LAYER_OF = {"supplier": "raw", "part": "staging", "orders": "curated", "customer": "serving"}


def _start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "fqn string")


def _layer():
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in _LAYER_OF.items() for x in kv]), F.col("platform"))


def _reach_sql(start: str, down: bool = True, extra: str = "", depth: int | None = None) -> str:
    a, b = ("source_fqn", "target_fqn") if down else ("target_fqn", "source_fqn")
    graph = f"(SELECT source_fqn, target_fqn FROM edges{extra})"
    stop = f" WHERE r.hop < {depth}" if depth else ""
    return f"""WITH RECURSIVE r(fqn, hop) AS (SELECT {b}, 1 FROM {graph} WHERE {a} = '{start}' UNION SELECT e.{b}, r.hop + 1 FROM r JOIN {graph} e ON e.{a} = r.fqn{stop})
    SELECT fqn, min(hop) AS hop FROM r GROUP BY 1"""


@query("j1_edge_append", d.with_ctes("SELECT relationship, count(*) AS edges FROM raw_edges GROUP BY 1", "raw_edges"))
def j1(spark, root):
    """Edges appended in two writes, listed as one table."""
    path = scratch_dir(spark, "edges")
    e = d.raw_edges(spark, root)
    e.filter("relationship = 'PLACED_BY'").write.mode("append").parquet(path)
    e.filter("relationship <> 'PLACED_BY'").write.mode("append").parquet(path)
    return spark.read.schema(e.schema).parquet(path).groupBy("relationship").agg(F.count(F.lit(1)).alias("edges"))


@query("j2_normalised_edges", d.with_ctes("SELECT e.job_name, count(DISTINCT e.edge_id) AS edges, count(*) AS mappings, CAST(sum(m.position) AS BIGINT) AS position_sum FROM nested_edges e JOIN mappings m ON m.edge_id = e.edge_id GROUP BY 1", "mappings"))
def j2(spark, root):
    edges, maps = lineage.normalise(d.nested_edges(use_utc(spark), root))
    per_edge = maps.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("p"))
    return edges.join(per_edge, "edge_id").groupBy("job_name").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("mappings"), F.sum("p").alias("position_sum"))


@query("j3_one_hop", d.with_ctes("SELECT source_fqn, target_fqn, CASE WHEN target_fqn = 'part.p7' THEN 'upstream' ELSE 'downstream' END AS side FROM edges WHERE source_fqn = 'part.p7' OR target_fqn = 'part.p7'", "edges"))
def j3(spark, root):
    return lineage.one_hop(d.edges(spark, root), "part.p7").select("source_fqn", "target_fqn", "side")


@query("j4_depth_bounded", d.with_ctes(_reach_sql("supplier.s1", depth=2), "edges"))
def j4(spark, root):
    return lineage.reach(d.edges(spark, root), _start(spark, "supplier.s1"), depth=2)


@query("j5_impact", d.with_ctes(_reach_sql("supplier.s1"), "edges"))
def j5(spark, root):
    return lineage.impact(d.edges(spark, root), _start(spark, "supplier.s1"))


_BACK = " UNION SELECT 'customer.c' || c_custkey, 'supplier.s' || (c_custkey % 7) FROM customer"


@query("j5_impact_cyclic", d.with_ctes(f"""WITH RECURSIVE r(fqn) AS (SELECT target_fqn FROM edges WHERE source_fqn = 'supplier.s1' UNION SELECT e.target_fqn FROM r JOIN (SELECT source_fqn, target_fqn FROM edges{_BACK}) e ON e.source_fqn = r.fqn) SELECT fqn FROM r""", "edges"))
def j5_cyclic(spark, root):
    """The same graph closed into cycles: customers feed suppliers."""
    c = d.table(spark, root, "customer").select(F.concat(F.lit("customer.c"), "c_custkey").alias("source_fqn"), F.concat(F.lit("supplier.s"), F.col("c_custkey") % 7).alias("target_fqn"))
    e = d.edges(spark, root).select("source_fqn", "target_fqn").unionByName(c)
    return lineage.impact(e, _start(spark, "supplier.s1")).select("fqn")


@query("j6_impact_report", d.with_ctes(f"SELECT fqn, hop, CASE split_part(fqn, '.', 1) WHEN 'part' THEN 'staging' WHEN 'orders' THEN 'curated' WHEN 'customer' THEN 'serving' END AS layer FROM ({_reach_sql('supplier.s2')})", "edges"))
def j6(spark, root):
    e = d.edges(spark, root)
    attributes = lineage.nodes(e).select("fqn", _layer().alias("layer"))
    return lineage.impact_report(e, _start(spark, "supplier.s2"), attributes)


@query("j7_provenance", d.with_ctes(_reach_sql("customer.c5", down=False), "edges"))
def j7(spark, root):
    return lineage.provenance(d.edges(spark, root), _start(spark, "customer.c5"))


@query("j8_edge_dedupe", d.with_ctes("SELECT relationship, strftime(created_at, '%Y-%m-%d') AS first_day, count(*) AS edges FROM (SELECT *, row_number() OVER (PARTITION BY source_fqn, target_fqn, relationship ORDER BY created_at, edge_id) AS rn FROM raw_edges) WHERE rn = 1 GROUP BY 1, 2", "raw_edges"))
def j8(spark, root):
    first = lineage.dedupe(d.raw_edges(spark, root))
    return first.groupBy("relationship", F.date_format("created_at", "yyyy-MM-dd").alias("first_day")).agg(F.count(F.lit(1)).alias("edges"))


_ENDS = "SELECT source_fqn AS fqn, source_platform AS platform FROM edges UNION SELECT target_fqn, target_platform FROM edges"


@query("j9_nodes", d.with_ctes(f"SELECT fqn, platform, split_part(fqn, '.', 2) AS label, split_part(fqn, '.', 1) AS schema FROM ({_ENDS})", "edges"))
def j9(spark, root):
    return lineage.nodes(d.edges(spark, root))


@query("j10_dag_levels", d.with_ctes("""WITH RECURSIVE r(fqn, level) AS (SELECT DISTINCT source_fqn, 0 FROM edges WHERE source_fqn NOT IN (SELECT target_fqn FROM edges) UNION SELECT e.target_fqn, r.level + 1 FROM r JOIN edges e ON e.source_fqn = r.fqn)
    SELECT fqn, max(level) AS level FROM r GROUP BY 1""", "edges"))
def j10(spark, root):
    levels, _cyclic = lineage.layers_of(d.edges(spark, root))
    return levels


@query("j11_degrees", d.with_ctes("SELECT fqn, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT source_fqn AS fqn, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target_fqn, 1, 0 FROM edges) GROUP BY 1", "edges"))
def j11(spark, root):
    return lineage.degrees(d.edges(spark, root))


@query("j12_neighbourhood", d.with_ctes("SELECT 'orders.o11' AS fqn UNION SELECT source_fqn FROM edges WHERE target_fqn = 'orders.o11' UNION SELECT target_fqn FROM edges WHERE source_fqn = 'orders.o11'", "edges"))
def j12(spark, root):
    return lineage.neighbourhood(d.edges(spark, root), "orders.o11")


@query("j13_graph_summary", d.with_ctes("SELECT (SELECT count(*) FROM (SELECT source_fqn FROM nested_edges UNION SELECT target_fqn FROM nested_edges)) AS datasets, (SELECT count(*) FROM nested_edges) AS edges, (SELECT count(*) FROM mappings) AS column_mappings, (SELECT count(DISTINCT job_name) FROM nested_edges) AS jobs", "mappings"))
def j13(spark, root):
    edges, maps = lineage.normalise(d.nested_edges(use_utc(spark), root))
    return lineage.graph_summary(edges, maps)


@query("j14_column_lineage", d.with_ctes("SELECT job_name, source_column, target_column, edge_id, position, transform_type FROM (SELECT *, row_number() OVER (PARTITION BY job_name, source_column, target_column ORDER BY edge_id, position) AS rn FROM mappings) WHERE rn = 1", "mappings"))
def j14(spark, root):
    return lineage.column_lineage(*lineage.normalise(d.nested_edges(use_utc(spark), root)))


@query("j14_job_ends", d.with_ctes("SELECT job_name, count(DISTINCT source_fqn) AS inputs, count(DISTINCT target_fqn) AS outputs, count(*) AS edges FROM nested_edges GROUP BY 1", "nested_edges"))
def j14_jobs(spark, root):
    return lineage.job_ends(d.nested_edges(use_utc(spark), root))


@query("j15_layer_overview", d.with_ctes(f"""SELECT CASE platform WHEN 'supplier' THEN 'raw' WHEN 'part' THEN 'staging' WHEN 'orders' THEN 'curated' ELSE 'serving' END AS layer, count(*) AS nodes, CAST(coalesce(sum(o), 0) AS BIGINT) AS outbound
    FROM ({_ENDS}) n LEFT JOIN (SELECT source_fqn, count(*) AS o FROM (SELECT DISTINCT source_fqn, target_fqn, job_name FROM raw_edges) GROUP BY 1) x ON x.source_fqn = n.fqn GROUP BY 1""", "edges"))
def j15(spark, root):
    raw = d.raw_edges(spark, root)
    return lineage.layer_overview(raw, lineage.nodes(raw).select("fqn", _layer().alias("layer")))


@query("j16_transform_types", d.with_ctes("SELECT transform_type, count(*) AS mapping_count FROM mappings GROUP BY 1", "mappings"))
def j16(spark, root):
    _, maps = lineage.normalise(d.nested_edges(use_utc(spark), root))
    return lineage.transform_distribution(maps)


_URN = "'urn:li:dataset:(urn:li:dataPlatform:' || {} || ',' || {} || ',PROD)'"


@query("j18_upstream_documents", d.with_ctes(f"""
    SELECT {_URN.format("target_platform", "target_fqn")} AS entity_urn, 'upstreamLineage' AS aspect_name, 0 AS part, count(*) AS item_count,
           CAST(to_json({{'upstreams': list({{'auditStamp': {{'time': 0, 'actor': 'urn:li:corpuser:datajobs'}}, 'dataset': u, 'type': 'TRANSFORMED'}} ORDER BY u)}}) AS VARCHAR) AS aspect
    FROM (SELECT target_platform, target_fqn, {_URN.format("source_platform", "source_fqn")} AS u FROM edges) GROUP BY target_platform, target_fqn""", "edges"))
def j18_up(spark, root):
    return lineage.upstream_documents(d.edges(spark, root), limit=100_000)


@query("j18_schema_documents", d.with_ctes(f"""
    SELECT {_URN.format("source_type", "asset_fqn")} AS entity_urn, 'schemaMetadata' AS aspect_name, 0 AS part, count(*) AS item_count,
           count(*) FILTER (WHERE contains(data_type, 'VARCHAR')) AS string_fields, count(classification) AS tagged_fields FROM classified GROUP BY source_type, asset_fqn""", "classified"))
def j18_schema(spark, root):
    c = classify(d.columns(spark, root)).withColumnRenamed("source_type", "platform").withColumnRenamed("ordinal", "field_key")
    return lineage.schema_documents(c, limit=100_000).drop("aspect")


@query("j18_property_documents", d.with_ctes(f"""
    SELECT {_URN.format("source_type", "fqn")} AS entity_urn, 'datasetProperties' AS aspect_name, CAST(to_json({{'description': coalesce(description, ''), 'customProperties': {{'domain': coalesce(domain, ''), 'sensitivity_level': sensitivity_level, 'data_owner': data_owner, 'quality_grade': quality_grade}}}}) AS VARCHAR) AS aspect FROM cat_assets""", "cat_assets"))
def j18_props(spark, root):
    return lineage.property_documents(d.assets(spark, root))


_IO = "SELECT DISTINCT l_orderkey AS job, 'supplier.s' || l_suppkey AS dataset, 'input' AS role FROM lineitem UNION SELECT DISTINCT l_orderkey, 'part.p' || l_partkey, 'output' FROM lineitem"


def _io(spark, root):
    li = d.table(spark, root, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return li.select(F.inline(F.array(
        F.struct(F.col("l_orderkey").alias("job"), F.concat(F.lit("supplier.s"), "l_suppkey").alias("dataset"), F.lit("input").alias("role")),
        F.struct(F.col("l_orderkey").alias("job"), F.concat(F.lit("part.p"), "l_partkey").alias("dataset"), F.lit("output").alias("role")),
    )))


@query("j18_job_documents", f"""
    SELECT 'urn:li:dataJob:(urn:li:dataFlow:(orchestrator,orders,PROD),' || job || ')' AS entity_urn, 'dataJobInputOutput' AS aspect_name, 0 AS part,
           count(*) FILTER (WHERE role = 'input') AS input_count, count(*) FILTER (WHERE role = 'output') AS output_count FROM ({_IO}) GROUP BY job""")
def j18_jobs(spark, root):
    return lineage.job_documents(_io(spark, root), "lake", "orders", limit=100_000).drop("aspect")


@query("j19_pipeline_edges", f"SELECT DISTINCT CASE role WHEN 'input' THEN dataset ELSE 'job.' || job END AS source_fqn, CASE role WHEN 'input' THEN 'job.' || job ELSE dataset END AS target_fqn FROM ({_IO})")
def j19(spark, root):
    return lineage.pipeline_edges(_io(spark, root))


@query("j20_dataset_lookup", d.with_ctes(f"SELECT fqn, platform FROM ({_ENDS}) WHERE contains(lower(fqn), 'p1')", "edges"))
def j20(spark, root):
    return lineage.find_datasets(lineage.nodes(d.edges(spark, root)), "P1").select("fqn", "platform")
