"""Lineage graph: edges, traversals, layering, column lineage, change documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import first_per_key, split_parts
from ..functions.scalars import datajob_urn, dataset_urn, fqn_label, fqn_schema
from ..session import cut_lineage

LAYERS = ("raw", "staging", "curated", "ml_feature", "serving")
BROADCAST_NODES = 500_000  # up to so many of a round go to the edges instead of the edges to a shuffle


# ---- edges and nodes ------------------------------------------------------
def append_edges(store: DataFrame, edges: DataFrame) -> DataFrame:
    return store.unionByName(edges, allowMissingColumns=True)


def normalise(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested edges -> (edge table, column-mapping table keyed by edge_id)."""
    edges = nested.withColumn("mapping_count", F.size("column_mappings")).drop("column_mappings")
    mappings = nested.select("edge_id", F.posexplode("column_mappings").alias("position", "m")).select("edge_id", "position", "m.*")
    return edges, mappings


def dedupe(edges: DataFrame, order: Sequence[str] = ("created_at", "edge_id")) -> DataFrame:
    """First edge of every (source, target, relationship). Copies collapse map-side before the shuffle."""
    return first_per_key(edges, ["source_fqn", "target_fqn", "relationship"], list(order))


def nodes(edges: DataFrame) -> DataFrame:
    """Every endpoint once, with platform, label and schema."""
    ends = edges.select(F.col("source_fqn").alias("fqn"), F.col("source_platform").alias("platform")).unionByName(
        edges.select(F.col("target_fqn").alias("fqn"), F.col("target_platform").alias("platform"))
    )
    return ends.groupBy("fqn").agg(F.min("platform").alias("platform")).select("fqn", "platform", fqn_label("fqn").alias("label"), fqn_schema("fqn").alias("schema"))


def one_hop(edges: DataFrame, fqn: str, direction: str = "both") -> DataFrame:
    """Edges touching an asset. ``both`` lists a self-loop twice, as two one-sided reads would."""
    up = edges.filter(F.col("target_fqn") == fqn).withColumn("side", F.lit("upstream"))
    down = edges.filter(F.col("source_fqn") == fqn).withColumn("side", F.lit("downstream"))
    return {"upstream": up, "downstream": down}.get(direction) if direction != "both" else up.unionByName(down)


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree per asset from one aggregate over both ends (a hub is summed map-side)."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("source_fqn").alias("fqn"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target_fqn").alias("fqn"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )))
    return ends.groupBy("fqn").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def neighbourhood(edges: DataFrame, fqn: str) -> DataFrame:
    """A node and its direct neighbours."""
    touching = edges.filter((F.col("source_fqn") == fqn) | (F.col("target_fqn") == fqn))
    return touching.select(F.explode(F.array("source_fqn", "target_fqn")).alias("fqn")).distinct()


# ---- traversal ------------------------------------------------------------
def _sent(found: DataFrame) -> DataFrame | None:
    """Rows of one round, broadcast when they are few; None when there are none."""
    n = found.limit(BROADCAST_NODES + 1).count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_NODES else found


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, direction: str = "downstream") -> DataFrame:
    """(fqn, hop) of everything reachable from ``start`` (a column ``fqn``), with the smallest hop.

    Semi-naive: each round joins only the newest nodes with the edges, drops what is
    known, and stops on an empty round. Start nodes appear only if a cycle leads back
    to them. Frontiers are checkpointed reliably, so the plan stays one round deep and
    a lost executor costs a re-read, not a re-computation; the two edge columns are
    cached for the loop, spread as they come rather than by key, so a hub fills no single
    block. A frontier of up to ``BROADCAST_NODES`` is broadcast, so the edges stay where they are; only a larger one
    shuffles them. A hub's edges meet a frontier row once and its targets are deduplicated
    map-side before the shuffle. The driver only learns how many a round found, up to that number.
    """
    a, b = ("source_fqn", "target_fqn") if direction == "downstream" else ("target_fqn", "source_fqn")
    hops = edges.select(F.col(a).alias("fqn"), F.col(b).alias("_next")).persist(StorageLevel.MEMORY_AND_DISK)
    frontier = _sent(start.select("fqn").distinct())
    found: DataFrame | None = None
    hop = 0
    try:
        while frontier is not None and (depth is None or hop < depth):
            hop += 1
            fresh = hops.join(frontier, "fqn", "left_semi").select(F.col("_next").alias("fqn")).distinct()
            if found is not None:
                fresh = fresh.join(found.select("fqn"), "fqn", "left_anti")
            fresh = cut_lineage(fresh.withColumn("hop", F.lit(hop)))
            frontier = _sent(fresh.select("fqn"))
            if frontier is None:
                break
            found = fresh if found is None else found.unionByName(fresh)
            if hop % 16 == 0:  # long chains: fold the rounds so far into one table
                found = cut_lineage(found)
    finally:
        hops.unpersist()
    return found if found is not None else start.select("fqn").limit(0).withColumn("hop", F.lit(0))


def impact(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything downstream, ordered by name."""
    return reach(edges, start).orderBy("fqn")


def provenance(edges: DataFrame, start: DataFrame) -> DataFrame:
    return reach(edges, start, direction="upstream").orderBy("fqn")


def impact_report(edges: DataFrame, start: DataFrame, attributes: DataFrame) -> DataFrame:
    """Impacted assets in breadth-first order with their attributes."""
    return reach(edges, start).join(attributes, "fqn", "left").orderBy("hop", "fqn")


def layers_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fqn, level) with level = longest path from any root, and the nodes no level exists for.

    Peeling by in-degree: a node's level comes when its last incoming edge goes. A round joins only the newest level with the
    edges, takes the counts from the nodes that are left and writes those once; the next level and what is left after it are
    both filters of that table. Up to ``BROADCAST_NODES`` nodes of a level are broadcast to the edges; a level that leaves no node waiting ends the
    loop without reading them. So a node is rewritten no oftener than it waits, and a chain costs one table per level. Levels
    are folded into one table every 16 rounds. Nodes on or behind a cycle never reach zero and are returned instead of looping forever.
    """
    hops = edges.select("source_fqn", "target_fqn").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = hops.select(F.col("source_fqn").alias("fqn"), F.lit(0).alias("n")).unionByName(hops.select("target_fqn", F.lit(1)).toDF("fqn", "n"))
        table = cut_lineage(ends.groupBy("fqn").agg(F.sum("n").alias("open")))
        done: DataFrame | None = None
        level = 0
        while True:
            free, rest = table.filter("open = 0").select("fqn"), table.filter("open > 0")
            sent = _sent(free)
            if sent is None:
                break
            ranked = free.withColumn("level", F.lit(level))
            done = ranked if done is None else done.unionByName(ranked)
            if level % 16 == 15:
                done = cut_lineage(done)
            if rest.isEmpty():
                table = rest
                break
            gone = hops.join(sent.withColumnRenamed("fqn", "source_fqn"), "source_fqn").groupBy(F.col("target_fqn").alias("fqn")).agg(F.count(F.lit(1)).alias("n"))
            table = cut_lineage(rest.join(gone, "fqn", "left").select("fqn", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open")))
            level += 1
    finally:
        hops.unpersist()
    left = table.select("fqn")
    return (left.limit(0).withColumn("level", F.lit(0)) if done is None else done), left


# ---- summaries ------------------------------------------------------------
def graph_summary(edges: DataFrame, mappings: DataFrame) -> DataFrame:
    """Distinct datasets, edges, column mappings and jobs."""
    ends = edges.select(F.explode(F.array("source_fqn", "target_fqn")).alias("fqn")).agg(F.count_distinct("fqn").alias("datasets"))
    per_edge = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("job_name").alias("jobs"))
    maps = mappings.agg(F.count(F.lit(1)).alias("column_mappings"))
    return per_edge.withColumn("datasets", ends.scalar()).withColumn("column_mappings", maps.scalar())


def column_lineage(edges: DataFrame, mappings: DataFrame) -> DataFrame:
    """(job, source column, target column) once each, the first mapping's transform winning."""
    joined = mappings.join(edges.select("edge_id", "job_name", "source_fqn", "target_fqn"), "edge_id")
    return first_per_key(
        joined.select("job_name", "source_column", "target_column", "edge_id", "position", "transform_type"),
        ["job_name", "source_column", "target_column"], ["edge_id", "position"],
    )


def job_ends(edges: DataFrame) -> DataFrame:
    """Distinct inputs and outputs per job, counted."""
    return edges.groupBy("job_name").agg(
        F.count_distinct("source_fqn").alias("inputs"), F.count_distinct("target_fqn").alias("outputs"), F.count(F.lit(1)).alias("edges")
    )


def layer_overview(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per layer in flow order: nodes and outbound edges, unique by (source, target, job)."""
    order = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    out = edges.select("source_fqn", "target_fqn", "job_name").distinct().groupBy(F.col("source_fqn").alias("fqn")).agg(F.count(F.lit(1)).alias("_o"))
    return (
        attributes.join(out, "fqn", "left")
        .groupBy("layer")
        .agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("_o"), F.lit(0)).cast("bigint").alias("outbound"))
        .orderBy(order)
    )


def transform_distribution(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("transform_type").agg(F.count(F.lit(1)).alias("mapping_count"))


def find_datasets(node_rows: DataFrame, text: str) -> DataFrame:
    return node_rows.filter(F.lower("fqn").contains(text.lower()))


# ---- documents ------------------------------------------------------------
def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def upstream_documents(edges: DataFrame, limit: int = 1000, emitted_ms: int = 0) -> DataFrame:
    """Upstream-lineage proposals per target; targets with many sources go out in bounded parts."""
    ups = edges.select("target_fqn", "target_platform", dataset_urn("source_platform", "source_fqn").alias("upstream")).distinct()
    split = split_parts(ups, ["target_fqn", "target_platform"], "upstream", limit)
    grouped = split.groupBy("target_fqn", "target_platform", "part").agg(F.sort_array(F.collect_list("upstream")).alias("_u"))
    entry = F.transform("_u", lambda u: F.struct(
        F.struct(F.lit(emitted_ms).cast("bigint").alias("time"), F.lit("urn:li:corpuser:datajobs").alias("actor")).alias("auditStamp"),
        u.alias("dataset"), F.lit("TRANSFORMED").alias("type"),
    ))
    return grouped.select(
        dataset_urn("target_platform", "target_fqn").alias("entity_urn"), F.lit("upstreamLineage").alias("aspect_name"), "part",
        F.size("_u").alias("item_count"), _json(entry.alias("upstreams")).alias("aspect"),
    )


def schema_documents(columns: DataFrame, limit: int = 2000) -> DataFrame:
    """Schema-metadata proposals: fields with native type, kind, nullability and class tag, in bounded parts."""
    split = split_parts(columns, ["asset_fqn", "platform"], "field_key", limit)
    kind = F.when(F.col("data_type").contains("VARCHAR"), "StringType").otherwise("NumberType")
    tag = F.when(F.col("classification").isNotNull(), F.array(F.concat(F.lit("urn:li:tag:"), F.col("classification")))).otherwise(F.array().cast("array<string>"))
    field = F.struct(
        "field_key", F.col("column_name").alias("fieldPath"), F.col("data_type").alias("nativeDataType"), kind.alias("type"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("is_nullable", F.lit(True)).alias("nullable"), tag.alias("tags"),
    )
    grouped = split.groupBy("asset_fqn", "platform", "part").agg(
        F.sort_array(F.collect_list(field)).alias("_f"), F.count(F.lit(1)).alias("item_count"),
        F.count_if(kind == "StringType").alias("string_fields"), F.count_if(F.col("classification").isNotNull()).alias("tagged_fields"),
    )
    return grouped.select(
        dataset_urn("platform", "asset_fqn").alias("entity_urn"), F.lit("schemaMetadata").alias("aspect_name"), "part", "item_count",
        "string_fields", "tagged_fields",
        _json(F.col("asset_fqn").alias("schemaName"), F.concat(F.lit("urn:li:dataPlatform:"), F.col("platform")).alias("platform"), F.transform("_f", lambda f: f.dropFields("field_key")).alias("fields")).alias("aspect"),
    )


def property_documents(assets: DataFrame) -> DataFrame:
    """Dataset-property proposals: description and governance properties per asset."""
    props = F.struct(*[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in (("domain", ""), ("sensitivity_level", "INTERNAL"), ("data_owner", ""), ("quality_grade", ""))])
    return assets.select(
        dataset_urn("source_type", "fqn").alias("entity_urn"), F.lit("datasetProperties").alias("aspect_name"),
        _json(F.coalesce("description", F.lit("")).alias("description"), props.alias("customProperties")).alias("aspect"),
    )


def job_documents(io: DataFrame, platform: str, flow: str, limit: int = 1000) -> DataFrame:
    """Job input/output proposals. ``io``: job, dataset, role (input|output)."""
    split = split_parts(io.distinct(), ["job"], "dataset", limit)
    urn = dataset_urn(F.lit(platform), F.col("dataset"))
    grouped = split.groupBy("job", "part").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "input", urn))).alias("_i"), F.sort_array(F.collect_list(F.when(F.col("role") == "output", urn))).alias("_o")
    )
    return grouped.select(
        datajob_urn(F.lit(flow), F.col("job")).alias("entity_urn"), F.lit("dataJobInputOutput").alias("aspect_name"), "part",
        F.size("_i").alias("input_count"), F.size("_o").alias("output_count"),
        _json(F.col("_i").alias("inputDatasets"), F.col("_o").alias("outputDatasets")).alias("aspect"),
    )


def pipeline_edges(io: DataFrame) -> DataFrame:
    """Edges of pipeline runs through the job node: input -> job, job -> output.

    Linear in the number of datasets; inputs × outputs per job would be quadratic and
    carries no more information.
    """
    job = F.concat(F.lit("job."), F.col("job"))
    return io.select(
        F.when(F.col("role") == "input", F.col("dataset")).otherwise(job).alias("source_fqn"),
        F.when(F.col("role") == "input", job).otherwise(F.col("dataset")).alias("target_fqn"),
    ).distinct()
