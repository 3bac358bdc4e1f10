"""Empty inputs, hot keys, cycles, retries, late rows, broken tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewarden import vocab
from lakewarden.functions import rows as R
from lakewarden.operators import access, alerts, audit, catalog, classification, enrichment, lineage, profiling, quality, transforms
from lakewarden.plans import derived as d
from lakewarden.session import scratch_dir
from lakewarden.sources import discovery, readers, sinks
from lakewarden.streaming import streams

ROOT = "/root/testdata/sf0.001"


# ---- hot keys ---------------------------------------------------------------
@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(50)}", rng.randrange(400), i, rng.randrange(1000)) for i in range(4000)]
    return spark.createDataFrame(rows, "k string, t int, id int, v int").cache()


def build(w):
    return {"s": F.sum("v").over(w.rowsBetween(-7, 0)), "m": F.max("v").over(w.rowsBetween(-7, 0)), "l": F.lag("v", 3).over(w)}


def test_framed_splits_hot_keys_exactly(skewed):
    plain = skewed.withColumns(build(Window.partitionBy("k").orderBy("t", "id")))
    split = R.framed(skewed, ["k"], ["t", "id"], 7, build, hot_rows=200, chunk_rows=50)
    assert sorted(plain.collect()) == sorted(split.select(*plain.columns).collect(), key=lambda r: r) or (
        sorted(map(str, plain.collect())) == sorted(map(str, split.select(*plain.columns).collect()))
    )


def test_numbered_is_dense(skewed):
    got = R.numbered(skewed, ["k"], ["t", "id"])
    w = Window.partitionBy("k").orderBy("t", "id")
    wrong = got.withColumn("_want", F.row_number().over(w) - 1).filter("_pos <> _want")
    assert wrong.count() == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantile(skewed, q):
    mine = {r.k: r.x for r in R.exact_quantile(skewed, ["k"], "v", q, "x").collect()}
    theirs = {r.k: r.x for r in skewed.groupBy("k").agg(F.percentile("v", q).alias("x")).collect()}
    assert mine.keys() == theirs.keys()
    assert all(abs(mine[k] - theirs[k]) < 1e-9 for k in mine)


def test_latest_and_first(skewed):
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), F.col("id").desc())
    want = skewed.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    assert sorted(map(tuple, R.latest_per_key(skewed, ["k"], ["t", "id"]).collect())) == sorted(map(tuple, want.collect()))
    first = R.first_per_key(skewed, ["k"], ["t", "id"]).filter("k = 'hot'").first()
    assert (first.t, first.id) == tuple(skewed.filter("k = 'hot'").orderBy("t", "id").first())[1:3]


def test_split_parts_bounds_groups(skewed):
    parts = R.split_parts(skewed, ["k"], "id", 100)
    assert parts.count() == skewed.count()
    assert parts.groupBy("k", "part").count().agg(F.max("count")).first()[0] <= 200
    assert parts.filter("k <> 'hot'").agg(F.max("part")).first()[0] == 0


def test_top_k_prunes_before_the_shuffle(skewed):
    text = R.top_k(skewed, ["k"], [F.col("v").desc(), F.col("id")], 3)._jdf.queryExecution().toString()
    assert text.count("WindowGroupLimit") >= 2


def test_transforms_with_hot_keys(spark):
    orders, customer, events = (d.table(spark, ROOT, t) for t in ("orders", "customer", "events"))
    plain = transforms.customer_360(orders, customer)
    split = transforms.customer_360(orders, customer, hot_rows=5, chunk_rows=95)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    plain = transforms.fraud_features(events)
    split = transforms.fraud_features(events, hot_rows=10, chunk_rows=9)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


# ---- profiles ---------------------------------------------------------------
def test_profile_of_empty_and_null_columns(spark):
    empty = spark.createDataFrame([], "a int, b string, c array<int>, t timestamp_ntz")
    rows = {r.column_name: r for r in profiling.profile_table(empty, "e").collect()}
    assert set(rows) == {"a", "b", "t"}
    assert all((r.row_count, r.null_count, r.distinct_count, r.min_value, r.avg_value) == (0, 0, 0, None, None) for r in rows.values())
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "a double, b int")
    r = {x.column_name: x for x in profiling.profile_table(nulls, "n").collect()}["a"]
    assert (r.row_count, r.null_count, r.distinct_count, r.avg_value) == (2, 2, 0, None)
    scored = quality.score_columns(profiling.profile_table(empty, "e")).first()
    assert (scored.completeness, scored.uniqueness, scored.overall) == (1.0, 0.0, 0.75)


def test_approx_profile_is_close(spark):
    li = d.table(spark, ROOT, "lineitem")
    exact = {r.column_name: r.distinct_count for r in profiling.profile_table(li, "lineitem").collect()}
    approx = {r.column_name: r.distinct_count for r in profiling.profile_table(li, "lineitem", "approx").collect()}
    assert all(abs(approx[c] - exact[c]) <= max(1, 0.15 * exact[c]) for c in exact)


def test_long_texts_are_counted_by_digest_and_returned_whole(spark):
    long = "x" * 200
    df = spark.createDataFrame([(long,), (long,), (long + "y",), ("short",), (None,)], "s string")
    counts = profiling.count_values({"t": df})
    assert profiling.distinct_counts(counts).first().distinct_count == 3
    top = profiling.frequent_values({"t": df}).orderBy("rank").collect()
    assert [(r.value, r.n) for r in top] == [(long, 2), ("short", 1), (long + "y", 1)]


def test_ranks_follow_the_text_itself(spark):
    head = "h" * 64
    rows = [(head + t, x) for t, x in zip("gfedcba", (0.1 + 0.2, 0.3, -0.0, 0.0, 1e-9, float("nan"), 1e30))] + [(head, None), ("zz", 0.3)]
    tables = {"t": spark.createDataFrame(rows, "s string, x double")}
    small = profiling.named(profiling.smallest_values(profiling.count_values(tables), tables), tables).orderBy("column_name", "rank").collect()
    assert [r.value for r in small if r.column_name == "s"] == [head, head + "a", head + "b", head + "c", head + "d"]
    assert [r.value for r in small if r.column_name == "x"] == ["0.000000", "0.300000", "1000000000000000000000000000000.000000", "NaN"]
    top = profiling.frequent_values(tables).orderBy("column_name", "rank").collect()
    assert [(r.value, r.n) for r in top if r.column_name == "s"] == [(head, 1), *[(head + c, 1) for c in "abcd"]]
    assert [(r.value, r.n) for r in top if r.column_name == "x"][:2] == [("0.000000", 3), ("0.300000", 3)]
    distinct = {r.column_name: r.distinct_count for r in profiling.profile_table(tables["t"], "t").collect()}
    assert distinct == {"s": 9, "x": 6}


def test_profile_of_tables_without_rows_or_columns(spark):
    tables = {"none": spark.createDataFrame([], "s string, x int"), "vector": spark.createDataFrame([([1.0],)], "v array<double>"), "one": spark.createDataFrame([("a", 1)], "s string, x int")}
    profile, errors = profiling.hydrate(tables, samples=True)
    got = {(r.table_name, r.column_name): (r.row_count, r.distinct_count, r.sample_values) for r in profile.collect()}
    assert got == {("none", "s"): (0, 0, []), ("none", "x"): (0, 0, []), ("one", "s"): (1, 1, ["a"]), ("one", "x"): (1, 1, ["1"])} and not errors


def test_one_bad_table_does_not_stop_the_run(spark, tmp_path):
    bad = tmp_path / "bad.parquet"
    spark.createDataFrame([(1,)], "a int").write.parquet(str(bad))
    broken = spark.read.parquet(str(bad))
    for f in bad.iterdir():
        if f.suffix == ".parquet":
            f.write_bytes(b"PAR1 not a table PAR1")
    good = d.table(spark, ROOT, "region")
    profile, errors = profiling.hydrate({"bad": broken, "region": good}, check=True)
    assert [e[0] for e in errors] == ["bad"]
    assert {r.table_name for r in profile.collect()} == {"region"}


def test_sampling_policy(spark):
    df = spark.range(20000).toDF("a")
    assert profiling.sampled(df, "postgresql", 9_999).count() == 20000
    assert 600 < profiling.sampled(df, "postgresql", 20_000).count() < 1400
    assert profiling.sampled(df, "sqlite", 10**9).count() == 20000


def test_score_of_missing_statistics(spark):
    df = spark.createDataFrame([(None, None, None), (10, 20, 5)], "row_count bigint, null_count bigint, distinct_count bigint")
    a, b = quality.score_columns(df).collect()
    assert (a.completeness, a.uniqueness, a.grade) == (1.0, 0.0, "B")
    assert (b.completeness, b.uniqueness) == (0.0, 1.0)


# ---- discovery --------------------------------------------------------------
def test_inclusion_dependencies(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "y int")
    e = spark.createDataFrame([], "z int")
    got = {(r.column_name, r.referenced_column): r.is_contained for r in discovery.inclusion_dependencies({"a": a, "b": b, "e": e}, [("a", "x"), ("b", "y"), ("e", "z")]).collect()}
    assert got[("x", "y")] and not got[("y", "x")]


def test_any_number_of_key_columns(spark):
    df = spark.range(3).select(*[(F.col("id") + int(i == 69)).alias(f"k{i}") for i in range(70)])
    got = {(r.column_name, r.referenced_column): r.is_contained for r in discovery.inclusion_dependencies({"t": df}, [("t", c) for c in df.columns]).collect()}
    assert len(got) == 70 * 69 and got[("k0", "k68")] and got[("k68", "k0")]
    assert not got[("k0", "k69")] and not got[("k69", "k68")]


def test_large_keys_minus_zero_and_dotted_names(spark):
    df = spark.range(300000000000, 300000000010).select(F.col("id").alias("a.b"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("z"))
    got = {r.column_name: r for r in profiling.profile_table(df, "t").collect()}
    assert got["a.b"].avg_value == 300000000004.5 and got["a.b"].distinct_count == 10
    assert got["z"].distinct_count == 1


def test_visibility_by_role_and_level(spark):
    a = spark.createDataFrame([("PUBLIC",), ("CONFIDENTIAL",), ("RESTRICTED",), ("ODD",), (None,)], "sensitivity_level string")
    assert {r[0] for r in access.visible_assets(a, "viewer").collect()} == {"PUBLIC", "ODD", None}
    assert access.visible_assets(a, "data_analyst").count() == 5
    assert access.visible_assets(a, "nobody").count() == 0


def test_idle_steps_are_evaluated(spark):
    e = spark.sql("SELECT timestamp_seconds(x) AS ts, x = 0 AS bad FROM VALUES (0L), (1500L) AS t(x)")
    got = {r["at"]: (r.errors, r.total) for r in alerts.sliding_ratio(e, F.col("bad"), 900, 300).collect()}
    assert got == {300: (1, 1), 600: (1, 1), 900: (1, 1), 1800: (0, 1), 2100: (0, 1), 2400: (0, 1)}


def test_nested_and_repeated_fields(spark):
    df = spark.createDataFrame([], "a int, r struct<b:int,s:struct<c:string>>, l array<struct<q:int>>, m map<string,int>")
    names = [(r[2], r[9]) for r in discovery.schema_rows("t", df.schema)]
    assert names == [("a", True), ("r", False), ("r.b", True), ("r.s", False), ("r.s.c", True), ("l", False), ("m", False)]


def test_schema_filters(spark):
    s = spark.createDataFrame([("public",), ("pg_catalog",), ("pgx",), ("information_schema",), ("pg",)], "schema_name string")
    assert [r.schema_name for r in discovery.visible_schemas(s, "postgresql").collect()] == ["pg", "public"]
    assert [r.schema_name for r in discovery.visible_schemas(s, "sqlite").collect()] == ["information_schema", "pg", "pg_catalog", "pgx", "public"]


def test_reader_options():
    fmt, o = readers.reader_options(readers.Connection("postgresql", "h", 5432, "db", "u", "p"), "s.t", split=("id", 0, 100, 8))
    assert (fmt, o["url"], o["numPartitions"], o["queryTimeout"]) == ("jdbc", "jdbc:postgresql://h:5432/db", "8", "30")
    assert readers.reader_options(readers.Connection("bigquery", "proj"), "d.t")[1]["table"] == "proj.d.t"
    with pytest.raises(ValueError):
        readers.reader_options(readers.Connection("oracle"), "t")
    with pytest.raises(ValueError):
        readers.reader_options(readers.Connection("csv"), "t")
    assert set(vocab.READABLE_SOURCES) < set(vocab.SOURCE_TYPES)


# ---- domains ----------------------------------------------------------------
@pytest.mark.parametrize("table,names,expected", [
    ("t", ["account", "x", "num"], "finance"),
    ("t", ["num", "x", "account"], None),
    ("accounts", ["x", "order_num"], "finance"),
    ("t", ["accountnum"], "finance"),
    ("num", ["account"], None),
    ("t", ["a"], None),
    ("staff_item", ["x"], "hr"),
])
def test_gap_patterns_follow_column_order(spark, table, names, expected):
    rows = [(table, n, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "t string, c string, o bigint")
    assert enrichment.infer_domains(df, ["t"], "t", "c", "o").first().domain == expected


# ---- catalog ----------------------------------------------------------------
def test_upsert_is_idempotent(spark):
    a = d.assets(spark, ROOT).select("fqn", "description", "row_count", "updated_at")
    batch = a.limit(5).withColumn("row_count", F.lit(-1).cast("bigint")).withColumn("description", F.lit("new"))
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    once = catalog.upsert_assets(a, batch)
    twice = catalog.upsert_assets(once, batch)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.filter("row_count = -1 AND description <=> 'new'").count() == 0
    assert once.filter("row_count = -1").count() == 5


def test_replace_table_never_overwrites_its_input(spark):
    path, staging = scratch_dir(spark, "now"), scratch_dir(spark, "next")
    spark.range(3).write.parquet(path)
    out = sinks.replace_table(spark, spark.read.parquet(path).withColumn("id", F.col("id") + 1), path, staging)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_partition_filter_prunes(spark):
    path = scratch_dir(spark, "days")
    a = d.assets(spark, ROOT).withColumn("ingest_date", F.to_date("ingested_at"))
    sinks.write_clustered(a, path, "ingest_date", ["source_type"], files_per_partition=2)
    kept = catalog.retained(spark.read.parquet(path), "ingest_date", "2024-01-31", 60)
    assert "PartitionFilters: [isnotnull(ingest_date" in kept._jdf.queryExecution().toString()


def test_typed_json_defaults(spark):
    df = spark.createDataFrame([(None,), ("",), ('{"a":"1"}',)], "tags string")
    got = [r.tags for r in catalog.typed_json(df, "tags", "map<string,string>", "{}").collect()]
    assert got == [{}, {}, {"a": "1"}]


# ---- audit, alerts ----------------------------------------------------------
def test_query_limits(spark):
    log = d.audit(spark, ROOT)
    with pytest.raises(ValueError):
        audit.query(log, limit=1001)
    assert "TakeOrderedAndProject" in audit.query(log)._jdf.queryExecution().toString()


def test_log_filters_reach_the_scan(spark):
    text = audit.query(d.audit(spark, ROOT), start="2024-01-05")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in text


def test_hold_time_breaks_at_gaps(spark):
    grid = spark.createDataFrame([("a", t, 1.0) for t in (0, 60, 120, 240, 300)] + [("b", 0, 1.0), ("b", 60, None), ("b", 120, 1.0)], "k string, t bigint, x double")
    got = alerts.firing(grid, ["k"], "t", F.col("x") > 0.5, 60, 120).collect()
    assert [(r.k, r.started_at, r.ended_at, r.fires_at) for r in got] == [("a", 0, 120, 120)]


def test_counter_restart_counts_from_zero(spark):
    rows = [("a", f"2024-01-01 00:00:0{i}", i, v) for i, v in enumerate((5, 9, 2, 4))]
    df = spark.createDataFrame(rows, "k string, ts string, seq int, value bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert alerts.counter_increase(df, ["k"], 3600).first().increase == 8


def test_quantile_above_last_bucket(spark):
    df = spark.createDataFrame([("2024-01-01", 1000.0)], "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert alerts.histogram_quantile(df, "v", 0.99, 300).first()["quantile"] == 600.0


def test_critical_silences_warning(spark):
    df = spark.createDataFrame([("A", "s", "warning", 1), ("A", "s", "critical", 2), ("A", "t", "warning", 3), ("B", "s", "info", 4)], "alertname string, service string, severity string, started_at int")
    assert sorted((r.alertname, r.service, r.severity) for r in alerts.grouped_alerts(df).collect()) == [("A", "s", "critical"), ("A", "t", "warning"), ("B", "s", "info")]


# ---- graphs -----------------------------------------------------------------
def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "source_fqn string, target_fqn string")


def test_cycles_end_and_are_reported(spark):
    g = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("r", "a"))
    start = lambda n: spark.createDataFrame([(n,)], "fqn string")
    assert [r.fqn for r in lineage.impact(g, start("a")).collect()] == ["a", "b", "c", "d"]
    assert [r.fqn for r in lineage.impact(g, start("x")).collect()] == ["x"]
    assert lineage.impact(g, start("d")).count() == 0
    assert [(r.fqn, r.hop) for r in lineage.reach(g, start("r"), depth=2).orderBy("hop").collect()] == [("a", 1), ("b", 2)]
    levels, cyclic = lineage.layers_of(g)
    assert [r.fqn for r in levels.collect()] == ["r"]
    assert sorted(r.fqn for r in cyclic.collect()) == ["a", "b", "c", "d", "x"]


def test_long_chain(spark):
    g = edges(spark, *[(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)])
    out = lineage.reach(g, spark.createDataFrame([("n00",)], "fqn string"))
    assert out.count() == 20 and out.agg(F.max("hop")).first()[0] == 20


def test_runs_across_blocks_of_time(spark):
    import itertools
    import random

    random.seed(4)
    rows = [(k, t, random.random() < p) for k, p in (("a", 0.9), ("b", 0.5), ("c", 1.0)) for t in range(0, 6000, 60) if random.random() < 0.97 or k == "c"]
    wanted = set()
    for k, points in itertools.groupby(sorted(r for r in rows if r[2]), key=lambda r: r[0]):
        run = []
        for t in [*[p[1] for p in points], None]:
            if run and (t is None or t != run[-1] + 60):
                if run[-1] - run[0] >= 180:
                    wanted.add((k, run[0], run[-1], len(run), run[0] + 180))
                run = []
            run.append(t)
    grid = spark.createDataFrame(rows, "k string, t bigint, x boolean")
    for block in (1, 2, 7, 4096):
        got = alerts.firing(grid, ["k"], "t", F.col("x"), 60, 180, block)
        assert {tuple(r) for r in got.collect()} == wanted
    assert {tuple(r) for r in alerts.firing(grid.filter("k = 'c'").drop("k"), [], "t", F.col("x"), 60, 180, 5).collect()} == {(0, 5940, 100, 180)}


def test_peeling_of_chains_diamonds_and_cycles(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    odd = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("a", "b"), ("a", "x")]
    edges = spark.createDataFrame(chain + odd, "source_fqn string, target_fqn string")
    levels, left = lineage.layers_of(edges)
    got = {r.fqn: r.level for r in levels.collect()}
    assert got == {f"n{i:03d}": i for i in range(41)} | {"a": 0, "b": 1, "c": 2, "d": 3}
    assert sorted(r.fqn for r in left.collect()) == ["x", "y", "z"]
    none, empty = lineage.layers_of(edges.limit(0))
    assert none.collect() == [] and empty.collect() == []


def test_longest_path_levels(spark):
    levels, _ = lineage.layers_of(edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d")))
    assert {r.fqn: r.level for r in levels.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_documents_are_split_not_cut(spark):
    e = edges(spark, *[(f"s{i}", "t") for i in range(50)]).withColumns({"source_platform": F.lit("p"), "target_platform": F.lit("p")})
    docs = lineage.upstream_documents(e, limit=10).collect()
    assert len(docs) > 1 and sum(r.item_count for r in docs) == 50


# ---- streams ----------------------------------------------------------------
def test_session_catalog(spark):
    spark.range(2).selectExpr("id", "id % 2 AS day").createOrReplaceTempView("seen_view")
    assert "seen_view" in {r.table_name for r in discovery.session_tables(spark).collect()}
    assert discovery.partitioning(spark, "seen_view").count() == 0


def test_late_rows_are_dropped_by_the_watermark(spark):
    path = scratch_dir(spark, "late")
    schema = "id int, event_time timestamp"
    put = lambda rows: spark.createDataFrame(rows, "id int, t string").select("id", F.col("t").cast("timestamp").alias("event_time")).coalesce(1).write.mode("append").parquet(path)
    put([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 05:00:00")])
    out, check = scratch_dir(spark, "late-out"), scratch_dir(spark, "late-check")
    run = lambda: streams.run_available(
        streams.windowed_counts(spark.readStream.schema(schema).parquet(path), "1 hour", "10 minutes"),
        lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}"), check)
    run()
    put([(3, "2024-01-01 00:30:00"), (4, "2024-01-01 09:00:00")])
    run()
    got = {r.bucket: r.n for r in spark.read.parquet(out).collect()}
    assert got == {1704067200: 1, 1704085200: 1}


def test_broken_records_go_to_dead_letters(spark):
    path = scratch_dir(spark, "broken")
    spark.createDataFrame([('{"audit_id":"1"}',), ("{nope",), ("",), ('{"other":1}',)], "value string").write.text(path)
    schema = spark.createDataFrame([], "audit_id string, n int").schema
    good, dead = streams.decoded(streams.read_json_lines(spark, path), schema)
    assert [r.audit_id for r in streams.drain_to_table(good, "good").collect()] == ["1"]
    assert streams.drain_to_table(dead, "dead").count() == 3


def test_rule_inventory(spark):
    r = classification.rule_inventory(spark).first()
    assert r.total_rules == 31 and len(vocab.CATEGORIES) == 38
    assert all(rule.level == vocab.CATEGORY_LEVEL.get(rule.category, rule.level) for rule in vocab.SERVICE_RULES)


@pytest.mark.parametrize("name", ["d11_pii_assets", "e4_term_scores", "e7_suggested_terms_sim", "e8_term_search", "f2_domains", "g1_asset_upsert", "g3_search", "g8_catalog_stats", "i1_rbac_decisions", "l6_silent_windows", "c10_grade_histogram"])
def test_no_product_of_tables(spark, name):
    """Operators one could write as products plan neither a cartesian nor a nested-loop join, and no Python."""
    from lakewarden.plans import QUERIES

    plan = QUERIES[name](spark, ROOT)._jdf.queryExecution().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert node not in plan


def test_few_nodes_of_a_round_go_to_the_edges(spark, monkeypatch):
    seen, cut = [], lineage.cut_lineage

    def kept(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(lineage, "cut_lineage", kept)
    g = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "b"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, joins in ((500_000, True), (1, False)):
            monkeypatch.setattr(lineage, "BROADCAST_NODES", most)
            seen.clear()
            out = lineage.reach(g, spark.createDataFrame([("a",), ("d",)], "fqn string"))
            assert sorted(map(tuple, out.collect())) == [("b", 1), ("c", 1), ("d", 2)]
            assert ("BroadcastHashJoin" in seen[0]) == joins
            seen.clear()
            levels, left = lineage.layers_of(edges(spark, ("a", "b"), ("b", "c"), ("x", "c")))
            assert sorted(map(tuple, levels.collect())) == [("a", 0), ("b", 1), ("c", 2), ("x", 0)] and left.collect() == []
            assert len(seen) == 3  # counts, and what two levels leave: the last level reads no edges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_split_parts_reads_its_rows_once(spark):
    rows = [("hot", i) for i in range(40)] + [("k", 1), (None, 1)] + [(None, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, u int").repartition(3, "u").distinct()
    out = R.split_parts(df, ["k"], "u", 10)
    parts = {k: sorted({r.part for r in out.collect() if r.k == k}) for k in ("hot", "k", None)}
    assert parts == {"hot": [0, 1, 2, 3], "k": [0], None: [0]} and out.count() == 61 and out.columns == ["k", "u", "part"]
    assert "isnotnull(k" not in out._jdf.queryExecution().optimizedPlan().toString().split("LeftOuter")[1]


def test_edges_keep_the_least_platforms_without_a_sort(spark):
    e = d.edges(spark, ROOT)
    assert {tuple(r) for r in e.select("source_platform", "target_platform").distinct().collect()} == {("supplier", "part"), ("part", "orders"), ("orders", "customer")}
    assert "SortAggregate" not in e._jdf.queryExecution().executedPlan().toString()


def test_names_beyond_a_task_are_spread(spark, monkeypatch):
    from lakewarden.operators import glossary

    names = spark.createDataFrame([(n, f"orders_{i % 5}") for i, n in enumerate(["customer_id", "sku", "SKU", "Top Line", "tax", "x", "", None] * 9)], "column_name string, table_name string")
    ranked = lambda: glossary.suggest_for_names(names, glossary.glossary(spark), table_col="table_name")
    whole = sorted(map(tuple, ranked().collect()))
    monkeypatch.setattr(glossary, "NAMES_PER_TASK", 3, raising=False)
    spread = ranked()
    assert sorted(map(tuple, spread.collect())) == whole and whole
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "FullOuter" not in plan
