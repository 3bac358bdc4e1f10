"""Catalog store: upsert, search, patches, statistics, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.rows import latest_per_key
from ..functions.scalars import sensitivity_rank
from .glossary import fold_updates

# Fields a re-hydration overwrites; every other field keeps its stored value.
MEASURED_FIELDS = (
    "sensitivity_level", "row_count", "size_bytes", "quality_score", "quality_grade", "quality_completeness",
    "quality_uniqueness", "quality_validity", "quality_consistency", "suggested_terms", "updated_at",
)
# Fields a steward may patch.
PATCHABLE_FIELDS = ("description", "data_owner", "data_steward", "domain", "tags")


def upsert_assets(current: DataFrame, batch: DataFrame, key: str = "fqn", measured: Sequence[str] = MEASURED_FIELDS) -> DataFrame:
    """Catalog after a batch: new names are inserted whole, known ones take only measured fields.

    One full outer join on the name, both sides already one row per name, so no key
    can be hot. The result is written to a new folder and swapped (`replace_table`).
    """
    cols = current.columns
    new = batch.select(*[F.col(c).alias(f"_new_{c}") for c in cols]).withColumn("_in", F.lit(True))
    old = current.withColumn("_was", F.lit(True))
    joined = old.join(new, old[key] == new[f"_new_{key}"], "full_outer")
    known, incoming = F.coalesce(F.col("_was"), F.lit(False)), F.coalesce(F.col("_in"), F.lit(False))
    out = []
    for c in cols:
        if c in measured:
            out.append(F.when(incoming, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(known, F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
    return joined.select(*out)


def replace_columns(current: DataFrame, batch: DataFrame, key: str = "asset_fqn") -> DataFrame:
    """Column rows after a batch: all old rows of a touched asset go, the batch's rows come."""
    touched = batch.select(key).distinct()
    return current.join(touched, key, "left_anti").unionByName(batch)


def search(
    assets: DataFrame, q: str | None = None, domain: str | None = None, sensitivity: str | None = None,
    source_type: str | None = None, active_only: bool = True, like: bool = False,
) -> DataFrame:
    """All matching assets. ``like`` keeps % and _ in ``q`` as wildcards."""
    if active_only:
        assets = assets.filter("is_active")
    if domain:
        assets = assets.filter(F.col("domain") == domain)
    if sensitivity:
        assets = assets.filter(F.col("sensitivity_level") == sensitivity.upper())
    if source_type:
        assets = assets.filter(F.col("source_type") == source_type)
    if q:
        needle, test = q.lower(), None
        for c in ("fqn", "description", "table_name", "schema_name"):
            text = F.lower(F.col(c))
            hit = F.coalesce(text.like(f"%{needle}%") if like else text.contains(needle), F.lit(False))
            test = hit if test is None else test | hit
        assets = assets.filter(test)
    return assets


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    """One page with the total beside it. The page is a bounded top-k, the total a scalar subquery."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("total", total.scalar()).withColumn("total_pages", F.ceil(F.col("total") / F.lit(limit)).cast("bigint"))


def search_page(assets: DataFrame, limit: int = 50, offset: int = 0, **criteria) -> DataFrame:
    return page(search(assets, **criteria), [F.col("updated_at").desc(), F.col("fqn")], limit, offset)


def asset_with_columns(assets: DataFrame, columns: DataFrame, fqn: str) -> DataFrame:
    """One asset and its columns ordered by name, as rows (a wide asset is not folded into one)."""
    a = assets.filter(F.col("fqn") == fqn).select("asset_id", "fqn", "domain", "sensitivity_level", "quality_grade")
    c = columns.filter(F.col("asset_fqn") == fqn).select("asset_id", "column_name", "data_type", "null_count", "distinct_count")
    return a.join(c, "asset_id", "left").orderBy("column_name")


def apply_patches(assets: DataFrame, patches: DataFrame, fields: Sequence[str] = PATCHABLE_FIELDS) -> DataFrame:
    """Steward edits: allowed fields only, the last writer of each field wins. ``patches``: fqn, field, value, ts, seq; values of fields that are no texts are JSON."""
    folded = fold_updates(patches.filter(F.col("field").isin(*fields)), "fqn", "field", "value", ["ts", "seq"], fields)
    kind = {f.name: f.dataType.simpleString() for f in assets.schema.fields}
    typed = lambda f: F.col(f) if kind.get(f, "string") == "string" else F.from_json(f, kind[f])
    ours = folded.select("fqn", *[typed(f).alias(f"_p_{f}") for f in fields], F.col("updated_at").alias("_p_at"))
    joined = assets.join(ours, "fqn", "left")
    return joined.withColumns({
        **{f: F.coalesce(F.col(f"_p_{f}"), F.col(f)) for f in fields if f in assets.columns},
        "updated_at": F.coalesce("_p_at", "updated_at"),
    }).select(*assets.columns)


def migrate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both layouts side by side; fields the old one lacks are NULL."""
    return old.unionByName(new, allowMissingColumns=True)


def active_count(assets: DataFrame) -> DataFrame:
    return assets.filter("is_active").agg(F.count(F.lit(1)).alias("active_assets"))


def stats(assets: DataFrame, columns: DataFrame) -> DataFrame:
    """Catalog statistics in long form: totals and counts by domain, level and source.

    Four groupings of one aggregate (grouping sets) share a single scan.
    """
    with_pii = columns.filter(F.col("classification") == "PII").select("asset_id").distinct().withColumn("_pii", F.lit(True))
    active = assets.filter("is_active").join(with_pii, "asset_id", "left")
    active = active.withColumns({c: F.coalesce(F.col(c), F.lit("none")) for c in ("domain", "sensitivity_level", "source_type")})
    grouped = active.groupingSets([["domain"], ["sensitivity_level"], ["source_type"], []], "domain", "sensitivity_level", "source_type").agg(
        F.count(F.lit(1)).alias("asset_count"),
        F.count_if(F.col("_pii")).alias("assets_with_pii"),
        F.round(F.sum(F.col("quality_score").cast("decimal(28,4)")).cast("double") / F.count("quality_score"), 6).alias("avg_quality"),
        F.grouping_id().alias("_g"),
    )
    kind = F.when(F.col("_g") == 3, "domain").when(F.col("_g") == 5, "sensitivity").when(F.col("_g") == 6, "source").otherwise("total")
    return grouped.select(
        kind.alias("dimension"), F.coalesce("domain", "sensitivity_level", "source_type", F.lit("all")).alias("member"),
        "asset_count", "assets_with_pii", "avg_quality",
    )


def typed_json(df: DataFrame, text_col: str, schema: str, default: str) -> DataFrame:
    """JSON text to a typed column; NULL and empty text become ``default``."""
    text = F.coalesce(F.when(F.col(text_col) != "", F.col(text_col)), F.lit(default))
    return df.withColumn(text_col, F.from_json(text, schema))


def retained(df: DataFrame, date_col: str, as_of: str, days: int) -> DataFrame:
    """Rows inside the retention window; on a day-partitioned table a pure partition filter."""
    return df.filter(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), days))


def expired(df: DataFrame, date_col: str, as_of: str, table: str = "assets") -> DataFrame:
    days = vocab.RETENTION_DAYS[table]
    return df.filter(F.col(date_col) < F.date_sub(F.lit(as_of).cast("date"), days))


def summary_report(assets: DataFrame, column_counts: DataFrame) -> DataFrame:
    """Totals plus grade and sensitivity histograms, ordered by rank. One aggregate over assets ⋈ per-asset counts."""
    joined = assets.join(column_counts, "asset_id", "left")
    grades = [g for g, _ in vocab.GRADES]
    total = joined.agg(
        F.count(F.lit(1)).alias("tables"), F.sum("row_count").cast("bigint").alias("rows"),
        F.sum("size_bytes").cast("bigint").alias("bytes"),
        F.coalesce(F.sum("column_count"), F.lit(0)).cast("bigint").alias("columns"),
        F.coalesce(F.sum("pii_column_count"), F.lit(0)).cast("bigint").alias("pii_columns"),
        *[F.count_if(F.col("quality_grade") == g).alias(f"grade_{g}") for g in grades],
        *[F.count_if(F.col("sensitivity_level") == s).alias(f"level_{s}") for s in vocab.SENSITIVITY],
    )
    names = ["tables", "rows", "bytes", "columns", "pii_columns", *[f"grade_{g}" for g in grades], *[f"level_{s}" for s in vocab.SENSITIVITY]]
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("measure"), F.col(n).cast("bigint").alias("value")) for i, n in enumerate(names, 1)])
    return total.select(F.inline(entries)).orderBy("position")


def latest_assets(history: DataFrame, order: Sequence[str] = ("updated_at", "asset_id")) -> DataFrame:
    return latest_per_key(history, ["fqn"], list(order))


def by_sensitivity(df: DataFrame) -> DataFrame:
    return df.orderBy(sensitivity_rank("sensitivity_level").desc(), "fqn")
