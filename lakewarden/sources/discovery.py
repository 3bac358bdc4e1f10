"""Discovery: schemas, tables, columns, types, keys."""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions.scalars import col_of

FIELD_SCHEMA = (
    "table_name string, ordinal int, column_name string, data_type string, is_nullable boolean, "
    "precision int, scale int, description string, is_leaf boolean, is_profiled boolean"
)


# ---- schemas and tables ---------------------------------------------------
def visible_schemas(schemas: DataFrame, source_type: str) -> DataFrame:
    """Schemas worth profiling: system ones dropped, ordered by name."""
    out = schemas.filter(~F.col("schema_name").isin(*vocab.SYSTEM_SCHEMAS.get(source_type, ()) or [""]))
    if source_type == "postgresql":
        # the underscore is a LIKE wildcard there: any schema of 'pg' plus one more character
        out = out.filter(~F.col("schema_name").rlike("^pg."))
    return out.orderBy("schema_name")


def allow_listed(df: DataFrame, schema_col: str, table_col: str, schemas: Iterable[str] = (), tables: Iterable[str] = ()) -> DataFrame:
    """Keep listed schemas and tables; an empty list keeps all."""
    schemas, tables = list(schemas), list(tables)
    if schemas:
        df = df.filter(F.col(schema_col).isin(*schemas))
    if tables:
        df = df.filter(F.col(table_col).isin(*tables))
    return df


def session_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views known to the session catalog."""
    rows = [(t.namespace[-1] if t.namespace else "", t.name, t.tableType) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "schema_name string, table_name string, table_type string")


def partitioning(spark: SparkSession, table: str) -> DataFrame:
    """Partition and bucket columns of a catalog table."""
    rows = [(table, c.name, c.isPartition, c.isBucket) for c in spark.catalog.listColumns(table) if c.isPartition or c.isBucket]
    return spark.createDataFrame(rows, "table_name string, column_name string, is_partition boolean, is_cluster boolean")


def virtual_schema(raw_name: Column | str) -> Column:
    """Schema implied by the prefix of a flat table name."""
    raw = F.lower(col_of(raw_name))
    expr = None
    for prefix, schema in vocab.PREFIX_SCHEMAS:
        expr = F.when(raw.startswith(prefix), schema) if expr is None else expr.when(raw.startswith(prefix), schema)
    return expr.otherwise("MAIN")


def virtual_table(raw_name: Column | str) -> Column:
    raw = col_of(raw_name)
    expr = None
    for prefix, _ in vocab.PREFIX_SCHEMAS:
        rest = F.substr(raw, F.lit(len(prefix) + 1))
        test = F.lower(raw).startswith(prefix)
        expr = F.when(test, rest) if expr is None else expr.when(test, rest)
    return F.upper(expr.otherwise(raw))


# ---- types ----------------------------------------------------------------
def type_map(spark: SparkSession) -> DataFrame:
    """(source_type, native, canonical), about a hundred rows of fixed size."""
    rows = [(s, native, canonical) for s, m in vocab.TYPE_MAPS.items() for native, canonical in m.items()]
    return spark.createDataFrame(rows, "source_type string, native string, canonical string")


def sqlite_affinity(native: Column | str) -> Column:
    raw = F.upper(F.coalesce(col_of(native), F.lit("")))
    expr = F.when(raw == "", "TEXT")
    for parts, affinity in vocab.AFFINITY:
        hit = F.lit(False)
        for part in parts:
            hit = hit | raw.contains(part)
        expr = expr.when(hit, affinity)
    expr = expr.when(raw.contains("DATE") | raw.contains("TIME"), F.trim(F.substring_index(raw, "(", 1)))
    return expr.otherwise("NUMERIC")


def canonical_types(df: DataFrame, source_col: str = "source_type", native_col: str = "native_type") -> DataFrame:
    """Adds ``canonical_type``. The map is a literal, so this is a projection, not a join.

    Unknown PostgreSQL types are upper-cased, all others pass through.
    """
    native = F.col(native_col)
    bare = F.trim(F.regexp_replace(F.lower(native), r"\(.*\)", ""))
    lookup = (
        F.when(F.col(source_col) == "postgresql", bare)
        .when(F.col(source_col) == "sqlite", sqlite_affinity(native))
        .otherwise(native)
    )
    expr = None
    for source, mapping in vocab.TYPE_MAPS.items():
        pairs = [F.lit(x) for kv in mapping.items() for x in kv]
        unknown = F.upper(native) if source == "postgresql" else native
        found = F.coalesce(F.try_element_at(F.create_map(*pairs), lookup), unknown)
        test = F.col(source_col) == source
        expr = F.when(test, found) if expr is None else expr.when(test, found)
    return df.withColumn("canonical_type", expr.otherwise(native))


# ---- columns --------------------------------------------------------------
def schema_rows(table: str, schema: T.StructType) -> list[tuple]:
    """One row per field; struct members follow their parent with dotted names."""
    rows: list[tuple] = []

    def walk(fields, prefix):
        for f in fields:
            name = f"{prefix}{f.name}"
            decimal = isinstance(f.dataType, T.DecimalType)
            nested = isinstance(f.dataType, T.StructType)
            repeated = isinstance(f.dataType, (T.ArrayType, T.MapType))
            rows.append((
                table, len(rows) + 1, name, f.dataType.simpleString(), f.nullable,
                f.dataType.precision if decimal else None, f.dataType.scale if decimal else None,
                (f.metadata or {}).get("comment"), not nested, not nested and not repeated,
            ))
            if nested:
                walk(f.dataType.fields, f"{name}.")

    walk(schema.fields, "")
    return rows


def column_scan(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of every table with type, nullability, ordinal, precision and scale."""
    rows = [r for name, df in tables.items() for r in schema_rows(name, df.schema)]
    return spark.createDataFrame(rows, FIELD_SCHEMA)


def profiled_fields(df: DataFrame) -> list[tuple[str, str, str]]:
    """(dotted name, type, expression) of the leaves statistics are computed for: no arrays, maps or structs."""
    out: list[tuple[str, str, str]] = []

    def walk(fields, path: tuple[str, ...]) -> None:
        for f in fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, here)
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append((".".join(here), f.dataType.simpleString(), ".".join(f"`{part.replace('`', '``')}`" for part in here)))

    walk(df.schema.fields, ())
    return out


# ---- keys -----------------------------------------------------------------
def candidate_keys(tables: dict[str, DataFrame], combos: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """Column sets that are unique and never null, found by one two-level aggregate per set.

    Level one counts each value (map-side combine copes with a value that fills
    a third of the table), level two counts values, so no distinct set is collected.
    """
    out = None
    for table, sets in combos.items():
        df = tables[table]
        for cols in sets:
            per_value = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            no_null = F.lit(True)
            for c in cols:
                no_null = no_null & F.col(c).isNotNull()
            one = per_value.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
                F.count_if(no_null).cast("bigint").alias("distinct_count"),
                F.coalesce(F.sum(F.when(~no_null, F.col("_n"))), F.lit(0)).cast("bigint").alias("null_count"),
            ).select(
                F.lit(table).alias("table_name"),
                F.lit("+".join(cols)).alias("key_columns"),
                "row_count", "distinct_count", "null_count",
                ((F.col("row_count") > 0) & (F.col("null_count") == 0) & (F.col("row_count") == F.col("distinct_count"))).alias("is_key"),
            )
            out = one if out is None else out.unionByName(one)
    return out


def inclusion_dependencies(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """Which columns' values are all contained in which others: foreign-key candidates.

    Every value carries a bit mask of the columns it occurs in; A is contained in
    B when the AND of the masks of A's values has bit B. One shuffle keyed by
    value with map-side OR, then a handful of bytes per task, for any number of
    pairs. Masks are as many words of 63 bits as the columns need.
    """
    words = range((len(columns) + 62) // 63)
    stacked = None
    for bit, (table, column) in enumerate(columns):
        one = tables[table].select(F.col(column).cast("string").alias("value"), *[F.lit(1 << bit % 63 if w == bit // 63 else 0).cast("bigint").alias(f"mask{w}") for w in words])
        stacked = one if stacked is None else stacked.unionByName(one)
    per_value = stacked.filter(F.col("value").isNotNull()).groupBy("value").agg(*[F.bit_or(f"mask{w}").alias(f"mask{w}") for w in words])
    aggs = []
    for bit in range(len(columns)):
        has = F.getbit(f"mask{bit // 63}", F.lit(bit % 63)) == 1
        aggs += [F.bit_and(F.when(has, F.col(f"mask{w}"))).alias(f"m{bit}_{w}") for w in words]
        aggs.append(F.count_if(has).alias(f"n{bit}"))
    summary = per_value.agg(*aggs)
    per_column = F.array(*[
        F.struct(
            F.lit(bit).alias("_bit"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
            F.col(f"n{bit}").cast("bigint").alias("distinct_values"), F.array(*[F.coalesce(F.col(f"m{bit}_{w}"), F.lit(0).cast("bigint")) for w in words]).alias("_common"),
        )
        for bit, (table, column) in enumerate(columns)
    ])
    others = F.array(*[F.struct(F.lit(bit).alias("_other"), F.lit(t).alias("referenced_table"), F.lit(c).alias("referenced_column")) for bit, (t, c) in enumerate(columns)])
    pairs = summary.select(F.inline(per_column)).select("*", F.inline(others)).filter(F.col("_bit") != F.col("_other"))
    return pairs.select(
        "table_name", "column_name", "referenced_table", "referenced_column", "distinct_values",
        (F.getbit(F.get("_common", F.floor(F.col("_other") / 63).cast("int")), F.col("_other") % 63) == 1).alias("is_contained"),
    )


# ---- keys nobody declared -------------------------------------------------
# Logarithm of the size and relative error (one sigma) of the sketches that decide which column sets are looked at exactly.
KEY_LOG, KEY_RSD = 12, 0.02
KEY_SIGMAS = 5


def _sets_at(df: DataFrame, sets: list[tuple[int, ...]], paths: list[str]) -> tuple[int, list[int], list[int]]:
    """Rows, nulls per column, and estimated number of different values per column set, from ONE scan."""
    aggs = ["count(1) AS n", *[f"count_if({p} IS NULL) AS m{i}" for i, p in enumerate(paths)]]
    for j, columns in enumerate(sets):
        present = " AND ".join(f"{paths[i]} IS NOT NULL" for i in columns)
        aggs.append(f"coalesce(hll_sketch_estimate(hll_sketch_agg(xxhash64({', '.join(paths[i] for i in columns)}), {KEY_LOG}) FILTER (WHERE {present})), 0) AS d{j}")
    row = df.selectExpr(*aggs).first()
    return row["n"], [row[f"m{i}"] for i in range(len(paths))], [row[f"d{j}"] for j in range(len(sets))]


def _exactly_unique(df: DataFrame, sets: list[tuple[int, ...]], paths: list[str]) -> list[tuple[int, ...]]:
    """The column sets of which no combination of values occurs twice: a two-level aggregate per set, all in one job."""
    if not sets:
        return []
    tests = []
    for j, columns in enumerate(sets):
        keyed = df.selectExpr(*[f"{paths[i]} AS k{n}" for n, i in enumerate(columns)])
        repeated = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
        tests.append(repeated.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most")).select(F.lit(j).alias("j"), "most"))
    found = {r["j"] for r in reduce(DataFrame.unionByName, tests).collect() if r["most"] == 1}
    return [columns for j, columns in enumerate(sets) if j in found]


def unique_combinations(tables: dict[str, DataFrame], width: int = 2) -> DataFrame:
    """table_name, key_columns (joined by +), key_width, row_count: every minimal set of up to ``width`` columns that identifies the rows.

    Found level by level over the columns of the schema. A set is looked at when its columns have no nulls, none of its
    subsets is a key already, and the numbers of values of its columns multiplied reach the number of rows. One scan per level sketches the values of
    all such sets; those whose estimate is within ``KEY_SIGMAS`` errors of the number of rows are checked exactly, each by
    an aggregate with map-side combine. The driver sees one row of counts per table and level. Tables without rows have no keys.
    """
    spark = next(iter(tables.values())).sparkSession
    found: list[tuple[str, str, int, int]] = []
    for table, df in tables.items():
        fields = profiled_fields(df)
        names, paths = [f[0] for f in fields], [f[2] for f in fields]
        keys: list[tuple[int, ...]] = []
        rows, distinct, usable = 0, {}, list(range(len(fields)))
        for level in range(1, width + 1):
            sets = [c for c in itertools.combinations(usable, level) if not any(set(k) <= set(c) for k in keys)]
            if level > 1:
                sets = [c for c in sets if _product([distinct[i] for i in c]) * (1 + KEY_SIGMAS * KEY_RSD) ** level >= rows]
            if not sets:
                continue
            rows, nulls, estimates = _sets_at(df, sets, paths)
            if level == 1:
                distinct = dict(zip((c[0] for c in sets), estimates))
                usable = [i for i in usable if not nulls[i]]
                if not rows:
                    break
            near = [c for c, n in zip(sets, estimates) if n >= rows * (1 - KEY_SIGMAS * KEY_RSD) and set(c) <= set(usable)]
            made = _exactly_unique(df, near, paths)
            keys += made
            found += [(table, "+".join(names[i] for i in c), level, rows) for c in made]
    return spark.createDataFrame(found, "table_name string, key_columns string, key_width int, row_count bigint")


def _product(numbers: Iterable[int]) -> float:
    return reduce(lambda a, b: a * float(b), numbers, 1.0)


# Values of one class can be contained in each other; class -> how a value is compared.
_CLASSES = {
    "n": (("tinyint", "smallint", "int", "bigint"), "CAST({p} AS BIGINT)"),
    "r": (("float", "double"), "CAST({p} AS DOUBLE) + 0D"),
    "s": (("string",), "{p}"),
    "t": (("date", "timestamp", "timestamp_ntz"), "CAST({p} AS TIMESTAMP_NTZ)"),
    "b": (("boolean",), "CAST({p} AS BIGINT)"),
}


def _class_of(type_name: str) -> tuple[str, str] | None:
    if type_name.startswith("decimal"):
        return type_name, "{p}"
    return next(((c, how) for c, (types, how) in _CLASSES.items() if type_name in types), None)


def column_sketches(tables: dict[str, DataFrame], log_entries: int = 12) -> DataFrame:
    """table_name, column_name, column_id, kind, row_count, low, high, sketch of every column, from one scan per table.

    The sketch keeps the smallest 2**log_entries hashes of a column's values; sketches of parts of a table can be merged.
    """
    out, first = [], 0
    for table, df in tables.items():
        aggs, entries = ["count(1) AS row_count"], []
        fields = profiled_fields(df)
        for i, (name, type_name, path) in enumerate(fields):
            kind = _class_of(type_name)
            if kind is None:
                continue
            value = kind[1].format(p=path)
            hashed = value if kind[0] in ("n", "r", "s", "b") else f"CAST({value} AS STRING)"
            order = f"left({value}, 64)" if kind[0] == "s" else f"CAST({value} AS DOUBLE)" if kind[0] in ("n", "r", "b") or kind[0].startswith("decimal") else f"date_format({value}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
            aggs += [f"theta_sketch_agg({hashed}, {log_entries}) AS s{i}", f"min({order}) AS lo{i}", f"max({order}) AS hi{i}", f"count({path}) AS c{i}"]
            text = kind[0] in ("s", "t")
            low, high = (f"lo{i}", f"hi{i}") if text else ("CAST(NULL AS STRING)",) * 2
            low_n, high_n = ("CAST(NULL AS DOUBLE)",) * 2 if text else (f"lo{i}", f"hi{i}")
            quoted = name.replace("\\", "\\\\").replace("'", "\\'")
            entries.append(f"struct('{quoted}' AS column_name, {first + i} AS column_id, '{kind[0]}' AS kind, c{i} AS value_count, {low} AS low, {high} AS high, {low_n} AS low_n, {high_n} AS high_n, s{i} AS sketch)")
        first += len(fields)
        if entries:
            out.append(df.selectExpr(*aggs).selectExpr(f"'{table}' AS table_name", "row_count", f"inline(array({', '.join(entries)}))"))
    return reduce(DataFrame.unionByName, out)


def possible_inclusions(sketches: DataFrame) -> DataFrame:
    """Pairs of columns (a, b) of one class that ranges and sketches do not rule out: a's values may all be in b.

    A hash that a's sketch keeps below both limits and b's does not keep belongs to a value b lacks, so a
    difference that is not empty is a proof. One row per column on either side.
    """
    a = sketches.filter("value_count > 0").select("kind", *[F.col(c).alias(f"a_{c}") for c in ("column_id", "low", "high", "low_n", "high_n", "sketch")])
    b = sketches.filter("value_count > 0").select("kind", *[F.col(c).alias(f"b_{c}") for c in ("column_id", "low", "high", "low_n", "high_n", "sketch")])
    inside = "a_column_id <> b_column_id AND coalesce(a_low >= b_low AND a_high <= b_high, true) AND coalesce(a_low_n >= b_low_n AND a_high_n <= b_high_n, true)"
    near = a.join(b, "kind").filter(inside)
    return near.filter(F.theta_sketch_estimate(F.theta_difference("a_sketch", "b_sketch")) == 0).select("a_column_id", "b_column_id")


def contained_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, referenced_table, referenced_column, distinct_values, references_key of every column all of whose values are in another.

    Sketches leave few pairs; the columns of these are checked exactly by ``inclusion_dependencies``. ``references_key``: the
    referenced column has no value twice and no null.
    """
    spark = next(iter(tables.values())).sparkSession
    sketches = column_sketches(tables).select("*").persist()
    columns = {r["column_id"]: r for r in sketches.select("column_id", "table_name", "column_name", "kind", "row_count").collect()}
    open_ = [(r["a_column_id"], r["b_column_id"]) for r in possible_inclusions(sketches).collect()]  # pairs of columns, no values
    sketches.unpersist()
    schema = "table_name string, column_name string, referenced_table string, referenced_column string, distinct_values bigint, references_key boolean"
    if not open_:
        return spark.createDataFrame([], schema)
    used = sorted({i for pair in open_ for i in pair})
    typed = {}
    for table, df in tables.items():
        mine = [i for i in used if columns[i]["table_name"] == table]
        if mine:
            path = {f[0]: (f[2], _class_of(f[1])) for f in profiled_fields(df)}
            # the class goes in front of the value, so equal texts of different classes stay apart
            typed[table] = df.selectExpr(*[f"concat('{columns[i]['kind']}:', CAST({path[columns[i]['column_name']][1][1].format(p=path[columns[i]['column_name']][0])} AS STRING)) AS c{i}" for i in mine])
    exact = inclusion_dependencies(typed, [(columns[i]["table_name"], f"c{i}") for i in used])
    facts = spark.createDataFrame([(f"c{i}", columns[i]["table_name"], columns[i]["column_name"], columns[i]["row_count"]) for i in used], "id string, t string, c string, n bigint")
    pairs = spark.createDataFrame([(f"c{a}", f"c{b}") for a, b in open_], "column_name string, referenced_column string")
    sizes = exact.select(F.col("column_name").alias("referenced_column"), F.col("distinct_values").alias("_values")).distinct()
    met = exact.filter("is_contained").join(pairs, ["column_name", "referenced_column"]).join(sizes, "referenced_column")
    own, other = facts.toDF("column_name", "_t", "_c", "_n"), facts.toDF("referenced_column", "_rt", "_rc", "_rn")
    return met.join(own, "column_name").join(other, "referenced_column").select(
        F.col("_t").alias("table_name"), F.col("_c").alias("column_name"), F.col("_rt").alias("referenced_table"), F.col("_rc").alias("referenced_column"), "distinct_values", (F.col("_values") == F.col("_rn")).alias("references_key")
    )
