"""Column profiling: one aggregate per table, one shuffle for everything about distinct values."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions.rows import top_k
from ..session import cut_lineage, scratch_dir
from ..sources.discovery import profiled_fields

# Values longer than this travel through the shuffle as their first characters and their SHA-256 digest.
INLINE_LENGTH = 64
_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_REALS = ("float", "double")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def is_numeric(type_name: str) -> bool:
    return type_name in _INTEGERS or type_name in _REALS or type_name.startswith("decimal")


def is_comparable(type_name: str) -> bool:
    return is_numeric(type_name) or type_name in _TIMES


def _text(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _as_text(expr: str, type_name: str) -> str:
    """Text of a value: plain decimals for floats (minus zero as zero), seconds for times."""
    if type_name in _REALS:
        return f"format_string('%.6f', CAST({expr} AS DOUBLE) + 0D)"
    if type_name in ("timestamp", "timestamp_ntz"):
        return f"date_format({expr}, 'yyyy-MM-dd HH:mm:ss')"
    return f"CAST({expr} AS STRING)"


def basic_stats(df: DataFrame, table: str, approx_distinct: bool = False, rsd: float = 0.05) -> DataFrame:
    """Rows, nulls, min, max, average of every column from ONE scan and ONE aggregate.

    With ``approx_distinct`` the same pass also keeps an HLL++ sketch per column;
    nothing but one row per task is shuffled. The aggregates are written as SQL
    expressions: a wide table has hundreds, and text is built far faster than columns.
    """
    aggs, entries = ["count(1) AS _rows"], []
    for i, (name, type_name, path) in enumerate(profiled_fields(df)):
        value = f"CASE WHEN NOT isnan({path}) THEN {path} END" if type_name in _REALS else path
        aggs.append(f"count_if({path} IS NULL) AS n{i}")
        low = high = "CAST(NULL AS STRING)"
        mean = "CAST(NULL AS DOUBLE)"
        if is_comparable(type_name):
            aggs += [f"{_as_text(f'min({value})', type_name)} AS lo{i}", f"{_as_text(f'max({value})', type_name)} AS hi{i}"]
            low, high = f"lo{i}", f"hi{i}"
        if is_numeric(type_name):
            # whole numbers are summed exactly; a double sum would lose digits of large keys
            exact = f"CAST(sum(CAST({value} AS DECIMAL(38, 0))) AS DOUBLE) / count({value})"
            aggs.append(f"{exact if type_name in _INTEGERS else f'avg(CAST({value} AS DOUBLE))'} AS avg{i}")
            mean = f"avg{i}"
        if approx_distinct:
            aggs.append(f"approx_count_distinct({path}, {rsd}D) AS d{i}")
        entries.append(
            f"struct({i + 1} AS ordinal, {_text(name)} AS column_name, {_text(type_name)} AS data_type, n{i} AS null_count, "
            f"{low} AS min_value, {high} AS max_value, {mean} AS avg_value" + (f", d{i} AS distinct_count)" if approx_distinct else ")")
        )
    one = df.selectExpr(*aggs)
    return one.selectExpr(f"{_text(table)} AS table_name", "_rows AS row_count", f"inline(array({', '.join(entries)}))")


def listed_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, column) of everything profiled; the position in this list is the column's number in ``count_values``."""
    return [(name, column) for name, df in tables.items() for column, _, _ in profiled_fields(df)]


def _key_of(path: str, type_name: str, exact: bool) -> tuple[str, str]:
    """(head, rest) of a value. Heads sort as the values' texts do; with the rest they tell all values apart.

    Texts above INLINE_LENGTH have their first characters as head and a digest as rest, so they do not cross the network.
    Where the printed form of a number or time is rounded, ``exact`` keeps what it hides as rest.
    """
    nothing = "CAST(NULL AS STRING)"
    if type_name == "string":
        return f"left({path}, {INLINE_LENGTH})", f"CASE WHEN length({path}) > {INLINE_LENGTH} THEN sha2({path}, 256) ELSE {nothing} END"
    if type_name in _REALS:
        value = f"(CAST({path} AS DOUBLE) + 0D)"  # minus zero is zero
        head = f"CASE WHEN {path} IS NOT NULL THEN coalesce(CAST(try_cast({value} AS DECIMAL(38, 6)) AS STRING), {_as_text(path, type_name)}) END"
        return head, f"CASE WHEN try_cast({value} AS DECIMAL(38, 6)) = {value} THEN {nothing} ELSE CAST({path} + 0 AS STRING) END" if exact else nothing
    if type_name in ("timestamp", "timestamp_ntz"):
        return _as_text(path, type_name), f"CASE WHEN date_trunc('second', {path}) = {path} THEN {nothing} ELSE CAST({path} AS STRING) END" if exact else nothing
    return f"CAST({path} AS STRING)", nothing


def long_values(df: DataFrame, first: int, exact: bool = True) -> DataFrame:
    """(column_id, head, rest) of every non-null value: a narrow unpivot. ``first`` is the number of the first column."""
    keys, entries = [], []
    for i, (_, type_name, path) in enumerate(profiled_fields(df)):
        head, rest = _key_of(path, type_name, exact)
        keys += [f"{head} AS h{i}", f"{rest} AS r{i}"]
        entries.append(f"{first + i}, h{i}, r{i}")
    return df.selectExpr(*keys).selectExpr(f"stack({len(entries)}, {', '.join(entries)}) AS (column_id, head, rest)").filter("head IS NOT NULL")


def count_values(tables: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    """(column_id, head, rest, n): how often each value of any table and column occurs, in ONE shuffle.

    Unpivot + group instead of many countDistinct: the map-side combine absorbs values
    that repeat a lot, and the group key spreads a table with a third of all values.
    """
    longs, first = [], 0
    for df in tables.values():
        if fields := profiled_fields(df):
            longs.append(long_values(df, first, exact))
        first += len(fields)
    return reduce(DataFrame.unionByName, longs).groupBy("column_id", "head", "rest").agg(F.count(F.lit(1)).alias("n"))


def named(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``column_id`` replaced by table_name and column_name."""
    columns = listed_columns(tables)
    name = lambda part: F.element_at(F.array(*[F.lit(c[part]) for c in columns]), F.col("column_id") + 1)
    return df.select(name(0).alias("table_name"), name(1).alias("column_name"), *[c for c in df.columns if c != "column_id"])


def distinct_counts(counts: DataFrame) -> DataFrame:
    """Exact distinct count per column number; the second level is a partial aggregate as well."""
    return counts.groupBy("column_id").agg(F.count(F.lit(1)).alias("distinct_count"))


def _long_texts(tables: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """(column_id, head, rest, value) of the texts above INLINE_LENGTH whose heads are among the few of ``wanted``."""
    out, first = [], 0
    for df in tables.values():
        fields = profiled_fields(df)
        strings = [(first + i, path) for i, (_, type_name, path) in enumerate(fields) if type_name == "string"]
        first += len(fields)
        if strings:
            pairs = ", ".join(f"{i}, {path}" for i, path in strings)
            texts = df.selectExpr(f"stack({len(strings)}, {pairs}) AS (column_id, value)").filter(F.length("value") > INLINE_LENGTH)
            out.append(texts.withColumn("head", F.left("value", F.lit(INLINE_LENGTH))).join(wanted, ["column_id", "head"], "left_semi"))
    return reduce(DataFrame.unionByName, out).select("column_id", "head", F.sha2("value", 256).alias("rest"), "value") if out else None


def frequent_values(tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """table_name, column_name, value, n, rank: the ``k`` most frequent values of every column; ties by the text itself.

    Values are counted by head and digest. All that can reach the first ``k`` places by count and head
    are kept, ties included; only for those texts are read, and ranked whole.
    """
    counts = count_values(tables, exact=False)
    near = counts.withColumn("_r", F.rank().over(Window.partitionBy("column_id").orderBy(F.col("n").desc(), "head"))).filter(F.col("_r") <= k).drop("_r")
    near = cut_lineage(near)
    found = near.filter("rest IS NULL").withColumn("value", F.col("head"))
    long = near.filter("rest IS NOT NULL")
    # heads of at most k places per column: a bounded broadcast
    texts = _long_texts(tables, F.broadcast(long.select("column_id", "head").distinct()))
    if texts is not None:
        whole = texts.join(long.select("column_id", "head", "rest", "n"), ["column_id", "head", "rest"])
        found = found.unionByName(whole.groupBy("column_id", "head", "rest", "n").agg(F.min("value").alias("value")))
    return named(top_k(found, ["column_id"], [F.col("n").desc(), F.col("value")], k).select("column_id", "value", "n", "rank"), tables)


def smallest_values(counts: DataFrame, tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """column_id, value, rank: ``k`` sample values per column in a repeatable form, the smallest by the text itself.

    The ``k`` smallest heads of a column hold its ``k`` smallest values; whole texts are read for those alone,
    and each task keeps no more than ``k`` of them.
    """
    by_head = Window.partitionBy("column_id").orderBy("head")
    few = cut_lineage(counts.withColumn("_r", F.dense_rank().over(by_head)).filter(F.col("_r") <= k).select("column_id", "head", F.col("rest").isNotNull().alias("more")).distinct())
    texts = _long_texts(tables, F.broadcast(few.filter("more").select("column_id", "head")))
    strings = {i for i, (_, type_name) in enumerate((c, t) for df in tables.values() for c, t, _ in profiled_fields(df)) if type_name == "string"}
    # numbers and times are their heads; of texts only those without a rest
    short = few.filter(~F.col("more") | ~F.col("column_id").isin(*strings)).select("column_id", F.col("head").alias("value")).distinct()
    if texts is not None:
        pruned = texts.withColumn("_r", F.dense_rank().over(Window.partitionBy("column_id").orderBy("value"))).filter(F.col("_r") <= k)
        short = short.unionByName(pruned.select("column_id", "value").distinct())
    return top_k(short, ["column_id"], [F.col("value")], k)


def sample_arrays(counts: DataFrame, tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """column_id, sample_values: the ``smallest_values`` of a column as an array."""
    listed = smallest_values(counts, tables, k).groupBy("column_id").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("ranked"))
    return listed.select("column_id", F.col("ranked.value").alias("sample_values"))


def null_percent(null_count, rows):
    return F.when(rows > 0, F.round(100.0 * null_count / rows)).cast("bigint")


def sampled(df: DataFrame, source_type: str, row_count: int, seed: int = 42) -> DataFrame:
    """Rows to profile: all of them up to the source's threshold, a Bernoulli sample above it."""
    threshold, percent = vocab.SAMPLING[source_type]
    if threshold is not None and row_count <= threshold:
        return df
    return df.sample(False, percent / 100.0, seed)


def decoded_estimates(df: DataFrame, rows: str = "row_count", n_distinct: str = "n_distinct", null_frac: str = "null_frac") -> DataFrame:
    """Optimizer statistics to counts: negative n_distinct is a share of rows, fractions truncate."""
    rows_, nd = F.col(rows), F.col(n_distinct)
    distinct = (
        F.when((nd < 0) & (rows_ > 0), (F.abs(nd) * rows_).cast("bigint"))
        .when(nd > 0, nd.cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    nulls = F.when(rows_ > 0, (F.col(null_frac) * rows_).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return df.withColumn("distinct_count", distinct).withColumn("null_count", nulls)


def table_stats(spark: SparkSession, tables: dict[str, DataFrame], with_files: bool = False) -> DataFrame:
    """Rows per table, and bytes and last change of the files when asked."""
    out = []
    for name, df in tables.items():
        if not with_files:
            out.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count"))
            continue
        files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        per_file = files.groupBy("file_path").agg(
            F.count(F.lit(1)).alias("n"), F.max("file_size").alias("b"), F.max("file_modification_time").alias("t")
        )
        out.append(per_file.agg(F.sum("n").alias("row_count"), F.sum("b").alias("size_bytes"), F.max("t").alias("last_modified")).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, out)


def observed_lengths(df: DataFrame, table: str) -> DataFrame:
    """Longest text per string column, one aggregate."""
    strings = [(name, path) for name, type_name, path in profiled_fields(df) if type_name == "string"]
    schema = "table_name string, column_name string, max_length int"
    if not strings:
        return df.sparkSession.createDataFrame([], schema)
    one = df.agg(*[F.max(F.length(path)).alias(f"l{i}") for i, (_, path) in enumerate(strings)])
    entries = [F.struct(F.lit(name).alias("column_name"), F.col(f"l{i}").alias("max_length")) for i, (name, _) in enumerate(strings)]
    return one.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))


def profile_table(df: DataFrame, table: str, mode: str = "exact") -> DataFrame:
    """Full column profile of one table; ``mode`` = exact | approx distinct counts."""
    if mode == "approx":
        return basic_stats(df, table, approx_distinct=True)
    return with_distinct(basic_stats(df, table), {table: df}, count_values({table: df}))


def with_distinct(stats: DataFrame, tables: dict[str, DataFrame], counts: DataFrame) -> DataFrame:
    distinct = named(distinct_counts(counts), tables)
    joined = stats.join(distinct, ["table_name", "column_name"], "left").fillna(0, ["distinct_count"])
    return joined.select(*stats.columns, "distinct_count")


def hydrate(tables: dict[str, DataFrame], mode: str = "exact", check: bool = False, samples: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Profile of every table as one plan, plus (table, error) for tables that could not be analysed.

    Statistics are one aggregate per table; the distinct values of all tables share one shuffle, from which
    distinct counts and, with ``samples``, sample_values are taken.

    A table whose plan cannot be built is skipped and reported; with ``check``
    each table is also executed on its own, so a corrupt file fails alone.
    """
    stats, read, errors = [], {}, []
    for name, df in tables.items():
        try:
            if check:
                profile_table(df, name, mode).write.format("noop").mode("overwrite").save()
            if profiled_fields(df):
                stats.append(basic_stats(df, name, approx_distinct=mode == "approx"))
                read[name] = df
        except Exception as exc:  # noqa: BLE001 - partial results beat none
            errors.append((name, str(exc).splitlines()[0]))
    if not stats:
        raise ValueError("no table could be profiled")
    profile = reduce(DataFrame.unionByName, stats)
    counts = count_values(read) if mode != "approx" or samples else None
    if mode != "approx":
        profile = with_distinct(profile, read, counts)
    if samples:
        listed = named(sample_arrays(counts, read), read)
        profile = profile.join(listed, ["table_name", "column_name"], "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    return profile, errors


def hydrate_each(tables: dict[str, DataFrame], mode: str = "exact") -> tuple[DataFrame, DataFrame]:
    """(profile, runs): every table profiled by a job of its own, its rows staged; a table that fails costs only itself.

    runs: table_name, status (completed or failed), columns_discovered, duration_secs, error. The driver holds one row per table.
    """
    spark = next(iter(tables.values())).sparkSession
    root, runs, done = scratch_dir(spark, "hydration"), [], []
    for i, (name, df) in enumerate(tables.items()):
        start, path = time.perf_counter(), f"{root}/{i}"
        fields, error = 0, None
        try:
            fields = len(profiled_fields(df))
            if fields:
                profile_table(df, name, mode).write.parquet(path)
                done.append(path)
        except Exception as exc:  # noqa: BLE001 - partial results beat none
            error = str(exc).splitlines()[0]
        runs.append((name, "completed" if error is None else "failed", fields if error is None else 0, time.perf_counter() - start, error))
    if not done:
        raise ValueError("no table could be profiled")
    return spark.read.parquet(*done), spark.createDataFrame(runs, "table_name string, status string, columns_discovered bigint, duration_secs double, error string")


# ---- sketches that outlive a scan -------------------------------------------
SKETCH_LOG = 14


def distinct_sketches(df: DataFrame, table: str, parts: Sequence[str] = (), log_size: int = SKETCH_LOG) -> DataFrame:
    """table_name, column_name, the ``parts`` (SQL expressions AS name, such as file or day), rows, sketch: from one scan, one row per part and column."""
    fields = profiled_fields(df)
    aggs = ["count(1) AS rows"]
    for i, (_, type_name, path) in enumerate(fields):
        value = f"xxhash64({path} + 0D)" if type_name in _REALS else f"xxhash64({path})"
        aggs.append(f"hll_sketch_agg(CASE WHEN {path} IS NOT NULL THEN {value} END, {log_size}) AS s{i}")
    names = [p.rsplit(" AS ", 1)[1] for p in parts]
    keyed = df.selectExpr("*", *parts)
    one = keyed.groupBy(*names).agg(*[F.expr(a) for a in aggs])
    entries = ", ".join(f"struct({_text(name)} AS column_name, s{i} AS sketch)" for i, (name, _, _) in enumerate(fields))
    return one.selectExpr(f"{_text(table)} AS table_name", *names, "rows", f"inline(array({entries}))")


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """table_name, column_name, rows, distinct_count of all parts together, without a look at the tables."""
    return sketches.groupBy("table_name", "column_name").agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))


def added_sketches(tables: dict[str, DataFrame], stored: DataFrame | None, log_size: int = SKETCH_LOG) -> DataFrame:
    """Sketches of the files that ``stored`` has none of yet; files known already are not read.

    File names are metadata of the scan: they are listed per table, and those known are left out of what is read again.
    """
    out = []
    for name, df in tables.items():
        if not profiled_fields(df):
            continue
        plain = lambda f: re.sub(r"^(\w+):/+", r"\1:/", f)  # noqa: E731  the two listings write roots differently
        known = set() if stored is None else {plain(r["file"]) for r in stored.filter(F.col("table_name") == name).select("file").distinct().collect()}
        new = [f for f in df.inputFiles() if plain(f) not in known]
        if new:
            out.append(distinct_sketches(df.sparkSession.read.schema(df.schema).parquet(*new), name, ["_metadata.file_path AS file"], log_size))
    return reduce(DataFrame.unionByName, out) if out else stored.limit(0)


def run_summary(profile: DataFrame, schema_col: str | None = None) -> DataFrame:
    """Schemas, tables and columns discovered by a run."""
    schemas = F.count_distinct(F.col(schema_col)) if schema_col else F.lit(1)
    per_table = profile.groupBy(*([schema_col] if schema_col else []), "table_name").agg(F.count(F.lit(1)).alias("cols"), F.first("row_count").alias("rows"))
    return per_table.agg(
        schemas.cast("bigint").alias("schemas_discovered"),
        F.count(F.lit(1)).alias("tables_discovered"),
        F.sum("cols").cast("bigint").alias("columns_discovered"),
        F.sum("rows").cast("bigint").alias("rows_profiled"),
    )


PROFILE_STRUCT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("data_type", T.StringType()),
    T.StructField("is_nullable", T.BooleanType()), T.StructField("is_primary_key", T.BooleanType()),
    T.StructField("is_foreign_key", T.BooleanType()), T.StructField("max_length", T.IntegerType()),
    T.StructField("precision", T.IntegerType()), T.StructField("scale", T.IntegerType()),
    T.StructField("description", T.StringType()), T.StructField("null_count", T.LongType()),
    T.StructField("distinct_count", T.LongType()), T.StructField("min_value", T.StringType()),
    T.StructField("max_value", T.StringType()), T.StructField("avg_value", T.DoubleType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])
TABLE_STRUCT = T.StructType([
    T.StructField("schema_name", T.StringType()), T.StructField("table_name", T.StringType()),
    T.StructField("table_type", T.StringType()), T.StructField("row_count", T.LongType()),
    T.StructField("size_bytes", T.LongType()), T.StructField("last_modified", T.TimestampType()),
    T.StructField("column_offset", T.LongType()), T.StructField("columns", T.ArrayType(PROFILE_STRUCT)),
    T.StructField("primary_keys", T.ArrayType(T.StringType())),
    T.StructField("foreign_keys", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("column", "referenced_schema", "referenced_table", "referenced_column")]))),
    T.StructField("indexes", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("partitioning", T.StructType([T.StructField("type", T.StringType()), T.StructField("field", T.StringType()), T.StructField("expiration_ms", T.LongType())])),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])
RAW_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("source_id", T.StringType()),
    T.StructField("source_type", T.StringType()), T.StructField("emitted_at", T.TimestampType()),
    T.StructField("schema_profile", T.StructType([
        T.StructField("database_name", T.StringType()), T.StructField("schema_name", T.StringType()),
        T.StructField("tables", T.ArrayType(TABLE_STRUCT)),
    ])),
    T.StructField("connector_version", T.StringType()), T.StructField("run_id", T.StringType()),
])
