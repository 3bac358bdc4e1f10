"""Queries over sources, column profiles and quality scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators import profiling, quality
from ..session import scratch_dir, use_utc
from ..sources import discovery, sinks
from ..sources.readers import LAKE_TABLES, lake
from . import derived as d
from .registry import query

# Columns of the lake as the oracle names them: (column, kind), kind n = numeric, r = real, t = time, s = text, b = not profiled.
LAKE_COLUMNS = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:r c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:r",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:r",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:r o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:r l_extendedprice:r l_discount:r l_tax:r l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:s value:r props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "embeddings": "vec_id:n label:n",
    "pages": "page_id:n url:s html:s",
    "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:s text:s",
}


def _cols(table: str):
    return [c.split(":") for c in LAKE_COLUMNS[table].split()]


def profiled(table: str):
    """(column, kind) of what is profiled, in order."""
    return [(c, k) for c, k in _cols(table) if k in "nrts"]


def _each(expr, tables=LAKE_TABLES, kinds="nrts") -> str:
    """UNION ALL over (table, column) of the SELECT that ``expr(table, column, kind)`` returns."""
    return " UNION ALL ".join(expr(t, c, k) for t in tables for c, k in _cols(t) if k in kinds)


def _text(kind: str, expr: str) -> str:
    if kind == "r":
        return f"format('{{:.6f}}', CAST({expr} AS DOUBLE) + 0)"
    if kind == "t":
        return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({expr} AS VARCHAR)"


def _shown(kind: str, column: str) -> str:
    """A value as text, as min and max print it."""
    return _text(kind, f'"{column}"')


def _counts(spark, root) -> tuple[DataFrame, dict[str, DataFrame]]:
    tables = lake(use_utc(spark), root)
    return profiling.count_values(tables), tables


def _stats(spark, root, tables=LAKE_TABLES) -> DataFrame:
    return reduce(DataFrame.unionByName, [profiling.basic_stats(df, name) for name, df in lake(use_utc(spark), root, tables).items()])


def _mean():
    """Mean to six decimals, after ten: so a printed half does not hang on the order in which doubles were added."""
    return F.round(F.round("avg_value", 10), 6)


# ---- A: sources, discovery, sinks ------------------------------------------
@query("a4_allow_lists", d.with_ctes("SELECT fqn, schema_name, table_name FROM cat_assets WHERE schema_name IN ('ECONOMY', 'PROMO') AND contains(table_name, 'customer')", "cat_assets"))
def a4(spark, root):
    a = discovery.allow_listed(d.assets(spark, root), "schema_name", "table_name", schemas=("ECONOMY", "PROMO"))
    return a.filter(F.col("table_name").contains("customer")).select("fqn", "schema_name", "table_name")


_RAW_NAME = "['finance_', 'hr_', 'product_', 'Finance_', 'misc_'][p_size % 5 + 1] || replace(p_name, ' ', '_') || '_' || p_partkey"


@query("a5_virtual_schemas", f"""
    SELECT raw_name, CASE WHEN lower(raw_name) LIKE 'finance\\_%' ESCAPE '\\' THEN 'FINANCE_DB' WHEN lower(raw_name) LIKE 'hr\\_%' ESCAPE '\\' THEN 'HR_DB'
           WHEN lower(raw_name) LIKE 'product\\_%' ESCAPE '\\' THEN 'PRODUCT_DB' ELSE 'MAIN' END AS schema_name,
           upper(regexp_replace(raw_name, '^(?i)(finance_|hr_|product_)', '')) AS table_name
    FROM (SELECT {_RAW_NAME} AS raw_name FROM part)""")
def a5(spark, root):
    p = d.table(spark, root, "part")
    raw = F.concat(d.pick(("finance_", "hr_", "product_", "Finance_", "misc_"), F.col("p_size") % 5), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey")
    return p.select(raw.alias("raw_name")).select("raw_name", discovery.virtual_schema("raw_name").alias("schema_name"), discovery.virtual_table("raw_name").alias("table_name"))


_TYPES = {"n": None, "r": "double", "t": "timestamp_ntz", "s": "string"}
INT_COLUMNS = {"r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber", "quality", "toxic", "label"}


@query("a6_column_scan", _each(lambda t, c, k: f"""
    SELECT '{t}' AS table_name, '{c}' AS column_name, {[x for x, _ in _cols(t)].index(c) + 1 + (1 if t == "embeddings" and c == "label" else 0)} AS ordinal,
           '{_TYPES[k] or ("int" if c in INT_COLUMNS else "bigint")}' AS data_type, {f'max(length("{c}")) AS max_length FROM {t}' if k == "s" else "NULL AS max_length"}"""))
def a6(spark, root):
    """Column metadata with observed text lengths: the schema is walked once, lengths come from one aggregate per table."""
    tables = lake(use_utc(spark), root)
    lengths = reduce(DataFrame.unionByName, [profiling.observed_lengths(df, n) for n, df in tables.items() if any(f.dataType.simpleString() == "string" for f in df.schema)])
    fields = discovery.column_scan(spark, tables).filter("is_profiled")
    return fields.join(lengths, ["table_name", "column_name"], "left").select("table_name", "column_name", "ordinal", "data_type", "max_length")


_NATIVE = {
    "teradata": ("CV", "I", "DA", "XX", "++", "N", "F"),
    "mssql": ("nvarchar", "int", "datetime2", "bit", "unknown_t", "money", "timestamp"),
    "bigquery": ("STRING", "INT64", "RECORD", "JSON", "INTERVAL", "BOOL", "NUMERIC"),
    "sqlite": ("VARCHAR(20)", "BIGINT", "DATETIME", "DOUBLE", "DECIMAL(10,2)", "BLOB", "TIMESTAMP(6)"),
    "postgresql": ("varchar(20)", "int8", "Numeric(10,2)", "tsvector", "oid", "timestamptz", "_text"),
}


@query("a7_canonical_types", d.with_ctes(f"""
    , maps AS (SELECT * FROM (VALUES {", ".join(f"({d.q(s)}, {d.q(n)}, {d.q(c)})" for s, m in vocab.TYPE_MAPS.items() for n, c in m.items())}) AS t(src, native, canonical)),
    cols AS (SELECT source_type, CASE source_type {" ".join(f"WHEN {d.q(s)} THEN {d.sql_list(v)}[(line - 1) % 7 + 1]" for s, v in _NATIVE.items())} END AS native_type FROM cat_columns),
    looked AS (SELECT *, CASE WHEN source_type = 'postgresql' THEN trim(regexp_replace(lower(native_type), '\\(.*\\)', ''))
        WHEN source_type = 'sqlite' THEN CASE WHEN contains(upper(native_type), 'INT') THEN 'INTEGER' WHEN regexp_matches(upper(native_type), 'CHAR|CLOB|TEXT') THEN 'TEXT'
             WHEN regexp_matches(upper(native_type), 'REAL|FLOA|DOUB') THEN 'REAL' WHEN contains(upper(native_type), 'BLOB') THEN 'BLOB'
             WHEN regexp_matches(upper(native_type), 'DATE|TIME') THEN trim(string_split(upper(native_type), '(')[1]) ELSE 'NUMERIC' END
        ELSE native_type END AS lookup FROM cols)
    SELECT source_type, native_type, coalesce(canonical, CASE WHEN source_type = 'postgresql' THEN upper(native_type) ELSE native_type END) AS canonical_type, count(*) AS column_count
    FROM looked LEFT JOIN maps ON src = source_type AND native = lookup GROUP BY ALL""".replace("\n    , maps AS", "WITH maps AS", 1), "cat_columns"))
def a7(spark, root):
    c = d.columns(spark, root)
    native = None
    for source, types in _NATIVE.items():
        test, value = F.col("source_type") == source, d.pick(types, (F.col("line") - 1) % 7)
        native = F.when(test, value) if native is None else native.when(test, value)
    typed = discovery.canonical_types(c.select("source_type", native.alias("native_type")))
    return typed.groupBy("source_type", "native_type", "canonical_type").agg(F.count(F.lit(1)).alias("column_count"))


@query("a8_nested_fields", """
    SELECT 'actor.id' AS column_name, count(*) AS row_count, count(*) - count(user_id) AS null_count, count(DISTINCT user_id) AS distinct_count FROM events
    UNION ALL SELECT 'actor.geo.zone', count(*), 0, count(DISTINCT user_id % 5) FROM events
    UNION ALL SELECT 'payload.k', count(*), count(*) - count(props ->> '$.k'), count(DISTINCT CAST(props ->> '$.k' AS INT)) FROM events
    UNION ALL SELECT 'event_id', count(*), 0, count(DISTINCT event_id) FROM events""")
def a8(spark, root):
    """Nested records profiled by their dotted leaves; arrays are skipped, parents carry no statistics."""
    e = d.events(spark, root)
    nested = e.select(
        "event_id", F.struct(F.col("user_id").alias("id"), F.struct((F.col("user_id") % 5).alias("zone")).alias("geo")).alias("actor"),
        F.struct(d.payload_k().alias("k")).alias("payload"), F.array("value").alias("readings"),
    )
    return profiling.profile_table(nested, "events").select("column_name", "row_count", "null_count", "distinct_count")


_KEY_SETS = {
    "customer": [("c_custkey",), ("c_name",)], "orders": [("o_orderkey",), ("o_custkey",)], "part": [("p_partkey",), ("p_name",)],
    "supplier": [("s_suppkey",)], "lineitem": [("l_orderkey", "l_linenumber")], "events": [("event_id",)], "conversations": [("conv_id", "turn")], "documents": [("doc_id",)],
}


@query("a9_candidate_keys", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{'+'.join(cs)}' AS key_columns, (SELECT count(*) FROM {t}) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cs)} FROM {t} WHERE {' AND '.join(c + ' IS NOT NULL' for c in cs)})) AS distinct_count, "
    f"(SELECT count(*) FROM {t} WHERE {' OR '.join(c + ' IS NULL' for c in cs)}) AS null_count, (SELECT count(*) FROM {t}) = (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cs)} FROM {t})) AS is_key"
    for t, sets in _KEY_SETS.items() for cs in sets))
def a9(spark, root):
    return discovery.candidate_keys(lake(use_utc(spark), root, tuple(_KEY_SETS)), _KEY_SETS)


def _combinations_sql() -> str:
    """Single columns that identify rows, and pairs of columns that do while neither alone does: counted one by one, nothing pruned."""
    parts = []
    for t in LAKE_TABLES:
        names = [c for c, _ in profiled(t)]
        one = " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) = count(\"{c}\") AND count(*) = count(DISTINCT \"{c}\") AND count(*) > 0 AS ok, count(*) AS n FROM {t}" for c in names)
        parts.append(f"SELECT '{t}' AS table_name, c AS key_columns, CAST(1 AS INT) AS key_width, n AS row_count FROM ({one}) WHERE ok")
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
        if pairs:
            two = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) = count(\"{a}\") AND count(*) = count(\"{b}\") AND count(*) = count(DISTINCT (\"{a}\", \"{b}\")) AND count(*) > 0 AS ok, count(*) AS n FROM {t}" for a, b in pairs)
            parts.append(f"SELECT '{t}', a || '+' || b, 2, n FROM ({two}) WHERE ok AND a NOT IN (SELECT c FROM ({one}) WHERE ok) AND b NOT IN (SELECT c FROM ({one}) WHERE ok)")
    return " UNION ALL ".join(parts)


@query("a9_unique_combinations", _combinations_sql())
def a9_combinations(spark, root):
    """All minimal keys of one or two columns in all tables, found from the schemas."""
    return discovery.unique_combinations(lake(use_utc(spark), root))


_KEY_COLUMNS = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("documents", "doc_id"), ("labels", "doc_id")]


@query("a10_foreign_keys", " UNION ALL ".join(
    f"SELECT '{ta}' AS table_name, '{ca}' AS column_name, '{tb}' AS referenced_table, '{cb}' AS referenced_column, (SELECT count(DISTINCT {ca}) FROM {ta}) AS distinct_values, "
    f"NOT EXISTS (SELECT 1 FROM {ta} x WHERE {ca} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {tb} y WHERE y.{cb} = x.{ca})) AS is_contained"
    for ta, ca in _KEY_COLUMNS for tb, cb in _KEY_COLUMNS if (ta, ca) != (tb, cb)))
def a10(spark, root):
    names = tuple(dict.fromkeys(t for t, _ in _KEY_COLUMNS))
    return discovery.inclusion_dependencies(lake(use_utc(spark), root, names), _KEY_COLUMNS)


_INCLUSION_VALUES = _each(lambda t, c, k: f"""SELECT DISTINCT '{k}' AS kind, '{t}' AS t, '{c}' AS c, {f'(CAST("{c}" AS DOUBLE) + 0)' if k == "r" else f'"{c}"'}::VARCHAR AS v FROM {t} WHERE "{c}" IS NOT NULL""")


@query("a10_contained_columns", f"""WITH vals AS ({_INCLUSION_VALUES}), sizes AS (SELECT t, c, count(*) AS n FROM vals GROUP BY 1, 2), counts AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in LAKE_TABLES)}),
    met AS (SELECT a.t, a.c, b.t AS rt, b.c AS rc, count(*) AS n FROM vals a JOIN vals b ON a.kind = b.kind AND a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
    SELECT m.t AS table_name, m.c AS column_name, rt AS referenced_table, rc AS referenced_column, m.n AS distinct_values, r.n = k.n AS references_key
    FROM met m JOIN sizes s ON s.t = m.t AND s.c = m.c AND s.n = m.n JOIN sizes r ON r.t = rt AND r.c = rc JOIN counts k ON k.t = rt""")
def a10_contained(spark, root):
    """Every column of every table whose values all occur in another one, found from the schemas."""
    return discovery.contained_columns(lake(use_utc(spark), root))


@query("a11_table_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in LAKE_TABLES))
def a11(spark, root):
    return profiling.table_stats(spark, lake(use_utc(spark), root))


@query("a11_file_stats")
def a11_files(spark, root):
    """Bytes and last change from file metadata (no SQL counterpart)."""
    return profiling.table_stats(spark, lake(use_utc(spark), root), with_files=True)


@query("a16_clustered_sink", d.with_ctes("SELECT strftime(ingested_at, '%Y-%m-%d') AS ingest_date, count(*) AS assets, CAST(sum(row_count) AS BIGINT) AS total_rows FROM cat_assets GROUP BY 1", "cat_assets"))
def a16(spark, root):
    """Write day-partitioned, clustered files; read them back."""
    path = scratch_dir(spark, "assets")
    a = d.assets(spark, root).withColumn("ingest_date", F.to_date("ingested_at"))
    sinks.write_clustered(a, path, "ingest_date", ["source_type", "domain", "sensitivity_level"])
    back = spark.read.schema(a.schema).parquet(path)
    return back.groupBy(F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date")).agg(F.count(F.lit(1)).alias("assets"), F.sum("row_count").alias("total_rows"))


@query("a17_json_dump", d.with_ctes("SELECT fqn, domain, quality_score, row_count, is_active FROM cat_assets", "cat_assets"))
def a17(spark, root):
    path = scratch_dir(spark, "dump")
    a = d.assets(spark, root).select("fqn", "domain", "quality_score", "row_count", "is_active")
    sinks.write_json(a, path)
    return spark.read.schema(a.schema).json(path)


@query("a18_schema_messages", d.with_ctes("""
    , sized AS (SELECT *, count(*) OVER (PARTITION BY source_type, schema_name) AS n FROM cat_assets),
    parted AS (SELECT *, CASE WHEN n > 50 THEN CAST('0x' || substr(md5(fqn), 1, 8) AS BIGINT) % CAST(ceil(n / 50.0) AS BIGINT) ELSE 0 END AS part FROM sized)
    SELECT source_type, schema_name, part, count(*) AS table_count, string_agg(table_name, ',' ORDER BY fqn) AS tables FROM parted GROUP BY ALL""".replace("\n    , sized", "WITH sized", 1), "cat_assets"))
def a18(spark, root):
    """One message per schema, oversized schemas in bounded parts."""
    a = d.assets(spark, root).select("source_type", "schema_name", "fqn", "table_name", "row_count")
    out = sinks.per_schema_messages(a, ["source_type", "schema_name"], "fqn", limit=50)
    return out.withColumn("tables", F.array_join(F.transform("tables", lambda t: t.table_name), ","))


# ---- B: column profiles ----------------------------------------------------
@query("b1_null_counts", _each(lambda t, c, k: f'SELECT \'{t}\' AS table_name, \'{c}\' AS column_name, count(*) AS row_count, count(*) - count("{c}") AS null_count FROM {t}'))
def b1(spark, root):
    return _stats(spark, root).select("table_name", "column_name", "row_count", "null_count")


@query("b2_distinct_counts", _each(lambda t, c, k: f'SELECT \'{t}\' AS table_name, \'{c}\' AS column_name, count(DISTINCT "{c}") AS distinct_count FROM {t}'))
def b2(spark, root):
    counts, tables = _counts(spark, root)
    return profiling.named(profiling.distinct_counts(counts), tables)


@query("b3_approx_distinct")
def b3(spark, root):
    """HLL++ estimates in the same single pass as the other statistics (compared within tolerance in the tests)."""
    parts = [profiling.basic_stats(df, n, approx_distinct=True) for n, df in lake(use_utc(spark), root).items()]
    return reduce(DataFrame.unionByName, parts).select("table_name", "column_name", "distinct_count")


@query("b3_merged_sketches", _each(lambda t, c, k: f'SELECT \'{t}\' AS table_name, \'{c}\' AS column_name, count(*) AS row_count, count(DISTINCT "{c}") AS distinct_count, true AS is_near, true AS nothing_new FROM {t}'))
def b3_merged(spark, root):
    """Stored sketches per file, merged: as near the exact counts as their error allows, and a second look at the same files adds none."""
    tables = lake(use_utc(spark), root)
    path = scratch_dir(spark, "sketches")
    profiling.added_sketches(tables, None).write.parquet(path)
    stored = spark.read.parquet(path)
    nothing_new = profiling.added_sketches(tables, stored).isEmpty()
    exact = profiling.named(profiling.distinct_counts(profiling.count_values(tables)), tables)
    near = F.abs(F.col("estimate") - F.col("distinct_count")) <= 1 + F.col("distinct_count") * 0.05
    merged = profiling.merged_distinct(stored).withColumnRenamed("distinct_count", "estimate")
    return merged.join(exact, ["table_name", "column_name"]).select("table_name", "column_name", F.col("rows").alias("row_count"), "distinct_count", near.alias("is_near"), F.lit(nothing_new).alias("nothing_new"))


@query("b4_min_max", _each(lambda t, c, k: f'SELECT \'{t}\' AS table_name, \'{c}\' AS column_name, {_text(k, f"min({chr(34)}{c}{chr(34)})")} AS min_value, {_text(k, f"max({chr(34)}{c}{chr(34)})")} AS max_value FROM {t}', kinds="nrt"))
def b4(spark, root):
    return _stats(spark, root).filter(F.col("min_value").isNotNull()).select("table_name", "column_name", "min_value", "max_value")


@query("b5_averages", _each(lambda t, c, k: f'SELECT \'{t}\' AS table_name, \'{c}\' AS column_name, round(round(avg("{c}"), 10), 6) AS avg_value FROM {t}', kinds="nr"))
def b5(spark, root):
    return _stats(spark, root).filter(F.col("avg_value").isNotNull()).select("table_name", "column_name", _mean().alias("avg_value"))


def _top_sql(order: str, with_n: bool) -> str:
    n = ", n" if with_n else ""
    return _each(lambda t, c, k: f"""
        SELECT table_name, column_name, shown AS value{n}, CAST(rank AS INT) AS rank FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, {_shown(k, c)} AS shown, count(*) AS n,
               row_number() OVER (ORDER BY {order}) AS rank FROM {t} WHERE "{c}" IS NOT NULL GROUP BY 3) WHERE rank <= 5""")


SAMPLES_SQL = _top_sql("shown", False)


@query("b6_sample_values", SAMPLES_SQL)
def b6(spark, root):
    """Five values of every column of every table, the smallest by their text."""
    counts, tables = _counts(spark, root)
    return profiling.named(profiling.smallest_values(counts, tables), tables).select("table_name", "column_name", "value", "rank")


@query("b7_frequent_values", _top_sql("n DESC, shown", True))
def b7(spark, root):
    """The five most frequent values of every column of every table, ties by their text."""
    return profiling.frequent_values(lake(use_utc(spark), root))


@query("b8_sampling_policy", d.with_ctes(f"""
    SELECT source_type, CASE source_type {" ".join(f"WHEN {d.q(s)} THEN " + ("true" if t is None else f"row_count > {t}") for s, (t, _) in vocab.SAMPLING.items())} END AS is_sampled,
           CASE source_type {" ".join(f"WHEN {d.q(s)} THEN {p}" for s, (_, p) in vocab.SAMPLING.items())} END::DOUBLE AS percent, count(*) AS assets, CAST(sum(row_count) AS BIGINT) AS total_rows
    FROM cat_assets GROUP BY ALL""", "cat_assets"))
def b8(spark, root):
    """Which assets a profile would sample, by source policy. Literal thresholds: a projection and one aggregate."""
    hit = pct = None
    for source, (threshold, percent) in vocab.SAMPLING.items():
        test = F.col("source_type") == source
        over = F.lit(True) if threshold is None else F.col("row_count") > threshold
        hit = F.when(test, over) if hit is None else hit.when(test, over)
        pct = F.when(test, F.lit(percent)) if pct is None else pct.when(test, F.lit(percent))
    a = d.assets(spark, root).select("source_type", hit.alias("is_sampled"), pct.alias("percent"), "row_count")
    return a.groupBy("source_type", "is_sampled", "percent").agg(F.count(F.lit(1)).alias("assets"), F.sum("row_count").alias("total_rows"))


@query("b8_sampled_profile")
def b8_sample(spark, root):
    """Profile of a Bernoulli sample of lineitem, taken only above the threshold (random, hence rows only)."""
    li = d.table(spark, root, "lineitem")
    rows = li.count()
    return profiling.basic_stats(profiling.sampled(li, "postgresql", rows), "lineitem", approx_distinct=True)


@query("b9_decoded_estimates", d.with_ctes("""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN nd < 0 AND row_count > 0 THEN CAST(trunc(abs(nd) * row_count) AS BIGINT) WHEN nd > 0 THEN CAST(trunc(nd) AS BIGINT) ELSE 0 END AS distinct_count,
           CAST(trunc(nf * row_count) AS BIGINT) AS null_count
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_count, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE l_discount - 0.05::DOUBLE END AS nd, l_tax AS nf FROM lineitem JOIN cat_assets ON asset_key = l_partkey)""", "cat_assets"))
def b9(spark, root):
    li = d.table(spark, root, "lineitem")
    a = d.assets(spark, root).select("asset_key", "row_count")
    nd = F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(F.col("l_discount") - 0.05)
    rows = li.join(a, F.col("l_partkey") == F.col("asset_key")).select("l_orderkey", "l_linenumber", "l_partkey", "row_count", nd.alias("n_distinct"), F.col("l_tax").alias("null_frac"))
    return profiling.decoded_estimates(rows).select("l_orderkey", "l_linenumber", "l_partkey", "distinct_count", "null_count")


HYDRATE_SQL = _each(lambda t, c, k: f"""
    SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count("{c}") AS null_count, count(DISTINCT "{c}") AS distinct_count,
           {_text(k, f'min("{c}")') if k in "nrt" else "NULL"} AS min_value, {_text(k, f'max("{c}")') if k in "nrt" else "NULL"} AS max_value,
           {f'round(round(avg("{c}"), 10), 6)' if k in "nr" else "NULL"} AS avg_value FROM {t}""")


@query("b10_full_profile", HYDRATE_SQL)
def b10(spark, root):
    """Every column of every table. Tables that cannot be analysed are skipped and reported by `hydrate`."""
    profile, _errors = profiling.hydrate(lake(use_utc(spark), root))
    return profile.select("table_name", "column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value", _mean().alias("avg_value"))


@query("b10_hydration_runs", " UNION ALL ".join(f"SELECT '{t}' AS table_name, 'completed' AS status, CAST({len(profiled(t))} AS BIGINT) AS columns_discovered, true AS has_duration, false AS has_error, count(*) AS row_count FROM {t}" for t in LAKE_TABLES) + " UNION ALL SELECT 'unreadable', 'failed', 0, true, true, NULL")
def b10_runs(spark, root):
    """The lake and one unreadable table, each profiled by a job of its own: 14 profiles and one failure."""
    path = scratch_dir(spark, "unreadable")
    d.table(spark, root, "region").selectExpr("r_name AS value").coalesce(1).write.text(path)
    tables = lake(use_utc(spark), root) | {"unreadable": spark.read.schema("a int").option("pathGlobFilter", "*.txt").parquet(path)}
    profile, runs = profiling.hydrate_each(tables)
    rows = profile.groupBy("table_name").agg(F.max("row_count").alias("row_count"))
    return runs.join(rows, "table_name", "left").select("table_name", "status", "columns_discovered", (F.col("duration_secs") > 0).alias("has_duration"), F.col("error").isNotNull().alias("has_error"), "row_count")


@query("b11_run_summary", f"""SELECT CAST(1 AS BIGINT) AS schemas_discovered, count(DISTINCT table_name) AS tables_discovered, count(*) AS columns_discovered,
    CAST((SELECT sum(n) FROM ({" UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in LAKE_TABLES)})) AS BIGINT) AS rows_profiled FROM ({_each(lambda t, c, k: f"SELECT '{t}' AS table_name, '{c}' AS column_name")})""")
def b11(spark, root):
    return profiling.run_summary(_stats(spark, root))


@query("b12_skip_nested", 'SELECT \'embeddings\' AS table_name, \'vec_id\' AS column_name, count(*) - count(vec_id) AS null_count FROM embeddings UNION ALL SELECT \'embeddings\', \'label\', count(*) - count(label) FROM embeddings')
def b12(spark, root):
    """The vector column is listed in the schema but has no statistics."""
    return profiling.basic_stats(d.table(spark, root, "embeddings"), "embeddings").select("table_name", "column_name", "null_count")


@query("b13_null_percent", d.with_ctes("SELECT column_name, ordinal, asset_key, CASE WHEN row_count > 0 THEN CAST(round(100.0::DOUBLE * null_count / row_count) AS BIGINT) END AS null_percent FROM cat_columns", "cat_columns"))
def b13(spark, root):
    return d.columns(spark, root).select("column_name", "ordinal", "asset_key", profiling.null_percent(F.col("null_count"), F.col("row_count")).alias("null_percent"))


# ---- C: quality ------------------------------------------------------------
_KEYS = "asset_key, ordinal"


@query("c1_completeness", d.with_ctes(f"SELECT {_KEYS}, completeness FROM scored", "scored"))
def c1(spark, root):
    return quality.score_columns(d.columns(spark, root)).select("asset_key", "ordinal", "completeness")


@query("c2_uniqueness", d.with_ctes(f"SELECT {_KEYS}, uniqueness, nearest(least(distinct_count / greatest(row_count, 1), 1.0::DOUBLE), 4) AS sim_uniqueness FROM scored", "scored"))
def c2(spark, root):
    c = quality.score_columns(d.columns(spark, root)).withColumnRenamed("uniqueness", "u")
    return quality.score_columns(c, "sim").select("asset_key", "ordinal", F.col("u").alias("uniqueness"), F.col("uniqueness").alias("sim_uniqueness"))


_SIM_PARTS = """sim_parts AS (SELECT *, 1.0::DOUBLE - null_count / greatest(row_count, 1) AS c_, least(distinct_count / greatest(row_count, 1), 1.0::DOUBLE) AS u_,
        CASE WHEN null_count / greatest(row_count, 1) > 0.5 THEN 0.5::DOUBLE WHEN distinct_count / greatest(row_count, 1) < 0.001 AND row_count > 10000 THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS v_ FROM cat_columns),
    sim_scored AS (SELECT *, c_ * 0.35::DOUBLE + u_ * 0.25::DOUBLE + v_ * 0.25::DOUBLE + 0.9::DOUBLE * 0.15::DOUBLE AS o_ FROM sim_parts)"""


@query("c3_validity_tiers", d.with_ctes(f"WITH {_SIM_PARTS} SELECT v_ AS validity, count(*) AS columns FROM sim_scored GROUP BY 1", "cat_columns"))
def c3(spark, root):
    return quality.score_columns(d.columns(spark, root), "sim").groupBy("validity").agg(F.count(F.lit(1)).alias("columns"))


@query("c3_measured_validity", """
    SELECT 'events.props' AS column_name, round(count(*) FILTER (WHERE regexp_matches(props, '^\\{"k": [0-9]+\\}$')) / count(props), 6) AS validity FROM events
    UNION ALL SELECT 'documents.lang', round(count(*) FILTER (WHERE regexp_matches(lang, '^(en|de)$')) / count(lang), 6) FROM documents
    UNION ALL SELECT 'orders.o_orderpriority', round(count(*) FILTER (WHERE regexp_matches(o_orderpriority, '^[1-3]-')) / count(o_orderpriority), 6) FROM orders""")
def c3_measured(spark, root):
    checks = [("events", "props", r'^\{"k": [0-9]+\}$'), ("documents", "lang", "^(en|de)$"), ("orders", "o_orderpriority", "^[1-3]-")]
    out = [d.table(spark, root, t).agg(F.round(quality.measured_validity(F.col(c), p), 6).alias("validity")).select(F.lit(f"{t}.{c}").alias("column_name"), "validity") for t, c, p in checks]
    return reduce(DataFrame.unionByName, out)


@query("c4_consistency", d.with_ctes("SELECT 1.0::DOUBLE AS service_consistency, 0.9::DOUBLE AS sim_consistency, count(*) AS columns FROM cat_columns", "cat_columns"))
def c4(spark, root):
    c = quality.score_columns(d.columns(spark, root)).withColumnRenamed("consistency", "service_consistency")
    s = quality.score_columns(c, "sim").withColumnRenamed("consistency", "sim_consistency")
    return s.groupBy("service_consistency", "sim_consistency").agg(F.count(F.lit(1)).alias("columns"))


@query("c5_overall_score", d.with_ctes(f"SELECT {_KEYS}, overall FROM scored", "scored"))
def c5(spark, root):
    return quality.score_columns(d.columns(spark, root)).select("asset_key", "ordinal", "overall")


@query("c5_overall_score_sim", d.with_ctes(f"WITH {_SIM_PARTS} SELECT {_KEYS}, nearest(o_, 4) AS overall, {d.grade_sql('o_')} AS grade FROM sim_scored", "cat_columns"))
def c5_sim(spark, root):
    return quality.score_columns(d.columns(spark, root), "sim").select("asset_key", "ordinal", "overall", "grade")


@query("c6_grades", d.with_ctes("SELECT grade, count(*) AS columns, min(overall) AS lowest, max(overall) AS highest FROM scored GROUP BY 1", "scored"))
def c6(spark, root):
    return quality.score_columns(d.columns(spark, root)).groupBy("grade").agg(F.count(F.lit(1)).alias("columns"), F.min("overall").alias("lowest"), F.max("overall").alias("highest"))


def _avg4(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28, 4))) AS DOUBLE) / count({x})"


@query("c7_table_scores", d.with_ctes(f"""
    , m AS (SELECT asset_fqn, count(*) AS column_count, {_avg4("completeness")} AS c, {_avg4("uniqueness")} AS u, {_avg4("validity")} AS v, {_avg4("consistency")} AS k FROM scored GROUP BY 1),
    o AS (SELECT *, c * 0.35::DOUBLE + u * 0.25::DOUBLE + v * 0.25::DOUBLE + k * 0.15::DOUBLE AS s FROM m)
    SELECT asset_fqn, column_count, nearest(c, 4) AS completeness, nearest(u, 4) AS uniqueness, nearest(v, 4) AS validity, nearest(k, 4) AS consistency, nearest(s, 4) AS overall, {d.grade_sql("s")} AS grade FROM o""".replace("\n    , m AS", "WITH m AS", 1), "scored"))
def c7(spark, root):
    return quality.score_tables(quality.score_columns(d.columns(spark, root)), ["asset_fqn"])


@query("c8_table_scores_sim", d.with_ctes(f"""WITH {_SIM_PARTS}, m AS (SELECT asset_fqn, count(*) AS column_count, {_avg4("nearest(o_, 4)")} AS s FROM sim_scored GROUP BY 1)
    SELECT asset_fqn, column_count, nearest(s, 4) AS overall, {d.grade_sql("s")} AS grade FROM m""", "cat_columns"))
def c8(spark, root):
    return quality.score_tables(quality.score_columns(d.columns(spark, root), "sim"), ["asset_fqn"], "sim")


@query("c9_quality_summary", d.with_ctes(f"""
    SELECT source_type, domain, count(*) AS total_assets, round({_avg4("quality_score")}, 6) AS avg_quality_score, count(*) FILTER (WHERE quality_grade = 'A') AS grade_a_count,
           count(*) FILTER (WHERE quality_grade = 'B') AS grade_b_count, count(*) FILTER (WHERE quality_grade = 'C') AS grade_c_count, count(*) FILTER (WHERE quality_grade IN ('D', 'F')) AS grade_df_count
    FROM cat_assets WHERE is_active GROUP BY 1, 2""", "cat_assets"))
def c9(spark, root):
    return quality.quality_summary(d.assets(spark, root))


@query("c10_grade_histogram", d.with_ctes("""
    SELECT a.asset_fqn, g.grade, count(s.grade) AS column_count, round(count(s.grade) / max(a.n), 6) AS share
    FROM (SELECT asset_fqn, count(*) AS n FROM scored GROUP BY 1) a CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('F')) AS g(grade)
    LEFT JOIN scored s ON s.asset_fqn = a.asset_fqn AND s.grade = g.grade GROUP BY 1, 2""", "scored"))
def c10(spark, root):
    return quality.grade_histogram(quality.score_columns(d.columns(spark, root)), ["asset_fqn"])


@query("c11_quality_trend", d.with_ctes(f"SELECT strftime(ingested_at, '%Y-%m') AS month, count(*) AS asset_count, round({_avg4('quality_score')}, 6) AS avg_quality_score FROM cat_assets GROUP BY 1", "cat_assets"))
def c11(spark, root):
    return quality.quality_trend(d.assets(spark, root))


@query("c12_grade_distribution", d.with_ctes("SELECT g.grade, count(a.fqn) AS asset_count FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('F')) AS g(grade) LEFT JOIN cat_assets a ON a.quality_grade = g.grade GROUP BY 1", "cat_assets"))
def c12(spark, root):
    return quality.grade_distribution(d.assets(spark, root))
