"""Quality scores of columns and tables, grades and their distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import grade_of, nearest

_W = vocab.QUALITY_WEIGHTS
GRADE_NAMES = tuple(g for g, _ in vocab.GRADES)


def weighted(completeness: Column, uniqueness: Column, validity: Column, consistency: Column) -> Column:
    return (
        completeness * F.lit(_W["completeness"]) + uniqueness * F.lit(_W["uniqueness"])
        + validity * F.lit(_W["validity"]) + consistency * F.lit(_W["consistency"])
    )


def completeness_of(rows: Column, nulls: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - nulls / F.greatest(rows, F.lit(1))))


def uniqueness_of(rows: Column, nulls: Column, distinct: Column) -> Column:
    return F.least(F.lit(1.0), distinct / F.greatest(rows - nulls, F.lit(1)))


def sim_validity(rows: Column, nulls: Column, distinct: Column) -> Column:
    base = F.greatest(rows, F.lit(1))
    return (
        F.when(nulls / base > 0.5, 0.5)
        .when((distinct / base < 0.001) & (rows > 10000), 0.7)
        .otherwise(0.95)
    )


def measured_validity(values: Column, pattern: str) -> Column:
    """Share of non-null values that match the column's pattern (an aggregate)."""
    return F.coalesce(F.count_if(values.rlike(pattern)) / F.count(values), F.lit(1.0))


def score_columns(df: DataFrame, profile: str = "service", rows: str = "row_count", nulls: str = "null_count", distinct: str = "distinct_count") -> DataFrame:
    """Adds completeness, uniqueness, validity, consistency, overall (4 decimals) and grade.

    ``profile`` = service: validity and consistency are 1, uniqueness counts non-null rows;
    sim: tiered validity, 0.9 consistency, uniqueness over all rows.
    The grade looks at the unrounded score.
    """
    r = F.coalesce(F.col(rows), F.lit(0))
    n = F.coalesce(F.col(nulls), F.lit(0))
    d = F.coalesce(F.col(distinct), F.lit(0))
    if profile == "service":
        r = F.greatest(r, F.lit(1))
        parts = (completeness_of(r, n), uniqueness_of(r, n, d), F.lit(1.0), F.lit(1.0))
    elif profile == "sim":
        base = F.greatest(r, F.lit(1))
        parts = (1.0 - n / base, F.least(d / base, F.lit(1.0)), sim_validity(r, n, d), F.lit(0.9))
    else:
        raise ValueError(f"unknown profile: {profile}")
    overall = weighted(*parts)
    names = ("completeness", "uniqueness", "validity", "consistency")
    return df.withColumns({
        **{name: nearest(part, 4) for name, part in zip(names, parts)},
        "overall": nearest(overall, 4),
        "grade": grade_of(overall),
    })


def _mean4(name: str) -> Column:
    # parts carry four decimals: an exact decimal sum makes the mean independent of row order
    return F.sum(F.col(name).cast("decimal(28,4)")).cast("double") / F.count(name)


def score_tables(columns: DataFrame, keys: list[str], profile: str = "service") -> DataFrame:
    """Table score from scored columns: mean parts re-weighted (service) or mean of overalls (sim)."""
    if profile == "sim":
        out = columns.groupBy(*keys).agg(F.count(F.lit(1)).alias("column_count"), _mean4("overall").alias("_o"))
        return out.select(*keys, "column_count", nearest("_o", 4).alias("overall"), grade_of("_o").alias("grade"))
    names = ("completeness", "uniqueness", "validity", "consistency")
    means = columns.groupBy(*keys).agg(F.count(F.lit(1)).alias("column_count"), *[_mean4(n).alias(f"_{n}") for n in names])
    overall = weighted(*[F.col(f"_{n}") for n in names])
    return means.select(
        *keys, "column_count", *[nearest(f"_{n}", 4).alias(n) for n in names],
        nearest(overall, 4).alias("overall"), grade_of(overall).alias("grade"),
    )


def quality_summary(assets: DataFrame) -> DataFrame:
    """Active assets by source type and domain: count, mean score, grade counts."""
    return (
        assets.filter("is_active")
        .groupBy("source_type", "domain")
        .agg(
            F.count(F.lit(1)).alias("total_assets"),
            F.round(_mean4("quality_score"), 6).alias("avg_quality_score"),
            F.count_if(F.col("quality_grade") == "A").alias("grade_a_count"),
            F.count_if(F.col("quality_grade") == "B").alias("grade_b_count"),
            F.count_if(F.col("quality_grade") == "C").alias("grade_c_count"),
            F.count_if(F.col("quality_grade").isin("D", "F")).alias("grade_df_count"),
        )
        .orderBy(F.desc("avg_quality_score"), "source_type", "domain")
    )


def grade_histogram(columns: DataFrame, keys: list[str], grade_col: str = "grade") -> DataFrame:
    """Columns per grade with share, zero-filled over all grades, without a join against the grade list."""
    counts = columns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(grade_col) == g).alias(f"_{g}") for g in GRADE_NAMES]
    )
    entries = F.array(*[F.struct(F.lit(g).alias("grade"), F.col(f"_{g}").alias("column_count")) for g in GRADE_NAMES])
    return counts.select(*keys, "_all", F.inline(entries)).withColumn("share", F.round(F.col("column_count") / F.col("_all"), 6)).drop("_all")


def grade_distribution(assets: DataFrame, grade_col: str = "quality_grade") -> DataFrame:
    """Assets per grade over the whole catalog, zero-filled."""
    counts = assets.agg(*[F.count_if(F.col(grade_col) == g).alias(f"_{g}") for g in GRADE_NAMES])
    entries = F.array(*[F.struct(F.lit(g).alias("grade"), F.col(f"_{g}").alias("asset_count")) for g in GRADE_NAMES])
    return counts.select(F.inline(entries))


def quality_trend(assets: DataFrame, time_col: str = "ingested_at") -> DataFrame:
    """Mean score by month of ingestion."""
    return assets.groupBy(F.date_format(time_col, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("asset_count"), F.round(_mean4("quality_score"), 6).alias("avg_quality_score")
    )
