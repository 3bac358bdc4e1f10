"""Profile -> quality -> classification -> domain over the lake's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classification, enrichment, profiling, quality
from ..session import cut_lineage, use_utc
from ..sources.readers import LAKE_TABLES, lake

FLAGSHIP_TABLES = LAKE_TABLES


def sample_values(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, sample_values: five values of every column, the smallest by their text."""
    return profiling.named(profiling.sample_arrays(profiling.count_values(tables), tables), tables)


def lake_report(spark: SparkSession, root: str, tables=FLAGSHIP_TABLES, mode: str = "exact") -> DataFrame:
    """One row per column: statistics, scores, class, and the domain and level of its table."""
    found = lake(use_utc(spark), root, tables)
    profile, _ = profiling.hydrate(found, mode, samples=True)
    scored = classification.classify(quality.score_columns(cut_lineage(profile)))  # one row per column, written once and read three times below
    domains = enrichment.infer_domains(scored, ["table_name"], "table_name", "column_name", "ordinal")
    levels = classification.table_sensitivity(scored, ["table_name"], "service").withColumnRenamed("sensitivity_level", "table_level")
    return scored.join(domains, "table_name", "left").join(levels, "table_name", "left").select(
        "table_name", "column_name", "data_type", "row_count", "null_count", "distinct_count", "min_value", "max_value",
        F.round("avg_value", 6).alias("avg_value"), "completeness", "uniqueness", "overall", "grade", "classification", "category",
        "sensitivity_level", "domain", "table_level",
    )
