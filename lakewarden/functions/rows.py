"""Skew-proof building blocks for keyed work.

One key may hold a third of all rows, so nothing here sends a whole group to
one task: latest/first rows are aggregates with map-side combine, top-k uses a
window filter Spark prunes before the shuffle, and row frames over a hot key
run on overlapping chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_KEY_ROWS = 1_000_000
CHUNK_ROWS = 250_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a partial aggregate (no window, no sort of the group)."""
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in lead])).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in lead])).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """``k`` rows per key; the rank filter is pushed below the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= k)


def split_parts(df: DataFrame, keys: Sequence[str], uid: str, limit: int) -> DataFrame:
    """Adds ``part``: groups above ``limit`` rows are cut by a hash of ``uid`` so none grows unbounded.

    The count is a partial aggregate; only oversized groups are joined back. The join is null-safe, as a plain one would
    filter nulls below the count, and ``df`` would be worked out once for each side; rows with a null key stay in part 0.
    """
    sizes = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    digest = F.conv(F.substring(F.md5(F.col(uid).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    parts = F.ceil(F.col("_n") / F.lit(limit))
    same, known = F.lit(True), F.lit(True)
    for k in keys:
        same, known = same & F.col(k).eqNullSafe(F.col(f"_of_{k}")), known & F.col(k).isNotNull()
    return (
        df.join(sizes, same, "left")
        .withColumn("part", F.when(known & F.col("_n").isNotNull(), F.pmod(digest, parts)).otherwise(0).cast("bigint"))
        .drop("_n", *[f"_of_{k}" for k in keys])
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    preceding: int,
    build,
    hot_rows: int = HOT_KEY_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Window expressions that look back at most ``preceding`` rows, safe for hot keys.

    ``build(window_spec)`` returns ``{name: Column}``. ``order`` must be a total order
    within a key. A count per key (partial aggregate over the key columns only) finds
    keys above ``hot_rows``. Ordinary keys take one plain window; hot keys are
    numbered over ranges and cut into chunks that overlap by ``preceding`` rows, so
    every task sees at most ``chunk_rows + preceding`` of them.
    """
    if preceding >= chunk_rows:
        raise ValueError("chunk_rows must exceed the frame")
    plain = Window.partitionBy(*keys).orderBy(*order)
    hot = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n"))
    if hot.isEmpty():
        return df.withColumns(build(plain))
    usual = df.join(hot, list(keys), "left_anti").withColumns(build(plain))
    busy = numbered(df.join(hot, list(keys), "left_semi"), keys, order)
    home = F.floor(F.col("_pos") / chunk_rows)
    tail = F.col("_pos") % chunk_rows >= chunk_rows - preceding
    spread = busy.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    chunk_window = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    chunked = spread.withColumns(build(chunk_window)).filter(F.col("_chunk") == F.col("_home")).drop("_pos", "_home", "_chunk")
    return usual.unionByName(chunked)


def _ranged(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range-partitioned rows with their range number, written once.

    The range bounds come from a sample. Reading the checkpoint, instead of planning
    the exchange twice, guarantees that every use sees the same ranges.
    """
    return cut_lineage(df.repartitionByRange(*[F.col(c) for c in columns]).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str | None = None) -> DataFrame:
    """Adds ``_pos``: rows (or ``weight``) that precede the row within its key, without one task per key.

    Range partitioning splits a hot key by its order columns. Numbers inside a range
    are local; the offset of a (key, range) is a running sum over one row per range,
    so at most one row per shuffle partition and key.
    """
    ranged = _ranged(df, [*keys, *order])
    amount = F.col(weight) if weight else F.lit(1)
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_local", F.coalesce(F.sum(amount).over(local), F.lit(0)))
        .join(offsets, [*keys, "_range"])
        .withColumn("_pos", F.col("_before") + F.col("_local"))
        .drop("_range", "_local", "_before")
    )


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, alias: str) -> DataFrame:
    """Interpolated quantile per key without holding a group's values in one buffer.

    Equal values are counted first (map-side combine), the distinct values are placed
    over ranges by running count, and the two order statistics around (n - 1) * q are
    picked by position.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(counts, keys, [value], "_n")
    sizes = placed.groupBy(*keys).agg(((F.sum("_n") - 1) * F.lit(q)).alias("_at"))
    low, high, first, last = F.floor("_at"), F.ceil("_at"), F.col("_pos"), F.col("_pos") + F.col("_n") - 1
    near = placed.join(sizes, list(keys)).select(
        *keys, "_at",
        F.when((first <= low) & (low <= last), F.col(value)).alias("_lo"),
        F.when((first <= high) & (high <= last), F.col(value)).alias("_hi"),
    )
    lo, hi, at = F.max("_lo"), F.max("_hi"), F.max("_at")
    return near.groupBy(*keys).agg((lo + (hi - lo) * (at - F.floor(at))).alias(alias))
