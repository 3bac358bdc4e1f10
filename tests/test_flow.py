"""Raw events to the catalog: gathering, order-free folding, versions; keys and inclusions nobody declared."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lakewarden import vocab
from lakewarden.operators import assembly, glossary, profiling, store
from lakewarden.plans import derived, flow
from lakewarden.session import scratch_dir
from lakewarden.sources import discovery
from lakewarden.streaming import catalog_flow, streams


def raw_event(event_id, table, rows, emitted, *cols, offset=0, **more):
    columns = [{"name": c, "data_type": "VARCHAR", "null_count": 0, "distinct_count": rows, "sample_values": []} for c in cols]
    tables = [] if table is None else [{"schema_name": "P", "table_name": table, "row_count": rows, "column_offset": offset, "columns": columns, **more}]
    return {"event_id": event_id, "source_id": "s", "source_type": "postgresql", "emitted_at": emitted, "run_id": f"run-{emitted[:10]}", "connector_version": "1", "schema_profile": {"database_name": "d", "schema_name": "P", "tables": tables}}


def frame(spark, events):
    lines = spark.createDataFrame([(json.dumps(e),) for e in events], "value string")
    return lines.select(F.from_json("value", profiling.RAW_EVENT).alias("e")).select("e.*")


def enriched(spark, events):
    return assembly.enriched_events(frame(spark, events))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


DAYS = [f"2024-01-{d:02d}T00:00:00Z" for d in range(1, 10)]
EVENTS = [raw_event(f"e{i}", t, 10 + i, DAYS[i], *cols, tags={"day": str(i)}) for i, (t, cols) in enumerate([("USERS", ("EMAIL", "AGE")), ("ITEMS", ("SKU",)), ("USERS", ("EMAIL",)), ("USERS", ("NAME_ONLY",)), ("EMPTY", ()), ("ITEMS", ("SKU", "PRICE"))])]


def ingested(spark, batches):
    ingest = catalog_flow.CatalogIngest(spark)
    for i, batch in enumerate(batches):
        ingest(enriched(spark, batch), i)
    return ingest


@pytest.fixture(scope="module")
def whole(spark):
    return ingested(spark, [EVENTS])


def test_first_event_gives_what_stays_and_last_what_is_measured(whole):
    assets = {r.fqn: r for r in whole.assets().collect()}
    users = assets["postgresql.P.USERS"]
    assert (users.row_count, users.tags, users.run_id, users.sensitivity_level, str(users.ingested_at)[:10], str(users.updated_at)[:10]) == (13, {"day": "0"}, "run-2024-01-01", "PUBLIC", "2024-01-01", "2024-01-04")
    assert users.description.startswith("Users contains records from the P schema. Key columns include: EMAIL, AGE.")
    assert (assets["postgresql.P.EMPTY"].quality_grade, assets["postgresql.P.EMPTY"].quality_score) == ("F", 0.0)
    assert sorted((r.asset_fqn, r.column_name) for r in whole.columns().collect()) == [("postgresql.P.ITEMS", "PRICE"), ("postgresql.P.ITEMS", "SKU"), ("postgresql.P.USERS", "NAME_ONLY")]


def test_any_order_and_batching_ends_in_the_same_tables(spark, whole):
    events = [*EVENTS, EVENTS[2]]  # one comes twice
    random.Random(1).shuffle(events)
    other = ingested(spark, [events[:2], events[2:]])
    assert rows(other.assets()) == rows(whole.assets()) and rows(other.columns()) == rows(whole.columns())


def test_repeated_batch_and_restart(spark, whole):
    ingest = ingested(spark, [EVENTS[:3], EVENTS[3:]])
    again = catalog_flow.CatalogIngest(spark, ingest.root)
    assert again.version == 1
    again(enriched(spark, EVENTS[3:]), 1)
    assert again.version == 1 and rows(again.assets()) == rows(whole.assets()) and rows(again.columns()) == rows(whole.columns())


def test_patches_of_stewards_outlive_hydrations(spark, whole):
    patches = spark.createDataFrame([("postgresql.P.USERS", "description", "by hand", "2024-01-02", 1), ("postgresql.P.USERS", "row_count", "7", "2024-01-02", 2), ("postgresql.P.USERS", "tags", '{"team": "a"}', "2024-01-02", 3)], "fqn string, field string, value string, ts string, seq int").withColumn("ts", F.col("ts").cast("timestamp"))
    users = whole.assets(patches).filter("table_name = 'USERS'").first()
    assert (users.description, users.row_count, users.tags) == ("by hand", 13, {"team": "a"})


def test_a_batch_writes_only_its_own_rows_until_a_bucket_is_full(spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    t = store.FoldedTable(spark, scratch_dir(spark, "folded"), "t", "k", ("at",), ("a",), ("b",), spark.createDataFrame([], "k string, at int, a int, b int").schema, buckets=2)
    make = lambda i, keys: spark.createDataFrame([(f"k{k}", i, 10 * i + k, 100 * i + k) for k in keys], "k string, at int, a int, b int")
    t.write(make(0, range(50)), 0)
    for i in range(1, 7):
        t.write(make(i, [3, 4]), i)
        files = spark.read.parquet(f"{t.root}/t/v={i}")
        assert files.count() == 2 or i in (3, 6)  # a full bucket is folded by the batch that touches it
        assert max(n for n in [sum(b == x for b, _ in t.manifest(i)) for x in (0, 1)]) <= 3
    got = {r.k: (r.a, r.at, r.b) for r in t.read().collect()}
    assert len(got) == 50 and got["k3"] == (3, 6, 603) and got["k9"] == (9, 0, 9)
    assert {r.k: r.at for r in t.read(2).collect()}["k3"] == 2  # earlier versions stay readable


def test_messages_of_one_event_are_gathered_in_a_stream(spark):
    path = scratch_dir(spark, "messages")
    parts = [raw_event("w", "WIDE", 10, DAYS[0], "C3", "C4", offset=2), raw_event("w", "OTHER", 5, DAYS[0], "EMAIL"), raw_event("w", "WIDE", 10, DAYS[0], "EMAIL", "AMOUNT")]
    for p in [*parts, raw_event("late", "OTHER", 5, DAYS[1], "AGE"), raw_event("end", None, 0, DAYS[2])]:
        spark.createDataFrame([(json.dumps(p),)], "value string").coalesce(1).write.mode("append").text(path)
    events, _ = streams.decoded(streams.read_json_lines(spark, path, max_files=2), profiling.RAW_EVENT)
    out = spark.read.text(catalog_flow.enrich_to_topic(events, scratch_dir(spark, "out")) + "/*").select(F.from_json("value", assembly.ENRICHED_EVENT).alias("e")).select("e.*").collect()
    got = {e.event_id: {t.table_name: [c.name for c in t.columns] for t in e.tables} for e in out}
    assert got == {"w": {"OTHER": ["EMAIL"], "WIDE": ["EMAIL", "AMOUNT", "C3", "C4"]}, "late": {"OTHER": ["AGE"]}}
    wide = next(t for e in out if e.event_id == "w" for t in e.tables if t.table_name == "WIDE")
    assert (wide.sensitivity_level, wide.domain, wide.row_count, wide.table_quality_score.grade) == ("RESTRICTED", "finance", 10, "A")
    assert wide.description == "Wide contains records from the P schema. Key columns include: EMAIL, AMOUNT, C3, C4. Auto-generated — please enrich via the Data Catalog UI."


def test_column_terms_agree_with_the_ranking_over_a_table(spark):
    from lakewarden.operators import glossary

    names = spark.createDataFrame([(n,) for n in ("CUSTOMER_ID", "customer", "client", "Top Line", "order_id", "SKU", "x", "", "tax", "revenue_total")], "column_name string")
    wanted = {}
    for r in glossary.suggest_for_names(names, glossary.glossary(spark)).orderBy("rank").collect():
        wanted.setdefault(r.column_name, []).append(r.term)
    got = {r.column_name: r.t for r in names.select("column_name", glossary.column_terms("column_name").alias("t")).collect()}
    assert got == {n: wanted.get(n, []) for n in got}


def test_minimal_keys(spark):
    t = spark.createDataFrame([(i, i // 2, i % 2, i // 4 if i else None, "c", float(i)) for i in range(40)], "id int, half int, bit int, hole int, same string, `a.b` double")
    got = {(r.table_name, r.key_columns, r.key_width, r.row_count) for r in discovery.unique_combinations({"t": t, "none": t.limit(0), "twice": t.union(t).select("id", "bit")}).collect()}
    assert got == {("t", "id", 1, 40), ("t", "a.b", 1, 40), ("t", "half+bit", 2, 40)}


def test_contained_columns(spark):
    many = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("small"), F.concat(F.lit("v"), F.col("id")).alias("name"))
    part = spark.createDataFrame([(5, "v3", "7", None, 0.5), (19999, "v4", "8", None, -0.0)], "fk bigint, who string, digits string, nothing int, x double")
    beyond = spark.createDataFrame([(5,), (20000,)], "gone bigint")
    got = {(r.column_name, r.referenced_column): (r.distinct_values, r.references_key) for r in discovery.contained_columns({"many": many, "part": part, "beyond": beyond}).collect()}
    assert got == {("fk", "k"): (2, True), ("who", "name"): (2, True), ("small", "k"): (7, True)}


def test_no_pair_is_left_to_check(spark):
    t = spark.createDataFrame([(1, "a")], "x int, y string")
    assert discovery.contained_columns({"t": t}).collect() == []


def test_messages_of_several_sources_come_from_one_pass(spark):
    rows = [(s, f"t{i % 3}", i, f"c{i}") for i in range(9) for s in ("mssql", "sqlite")]
    cols = spark.createDataFrame(rows, "source_type string, table_name string, ordinal long, column_name string").selectExpr(
        "*", "'s' as schema_name", "5L as row_count", "'INT' as data_type", "0L as null_count", "1L as distinct_count", "array('x') as sample_values")
    made = lambda c, source: [str(r) for r in assembly.raw_events(c, "lake", source, "lake", "run", "2024-01-31T00:00:00Z", limit=4).collect()]
    apart = [r for s in ("mssql", "sqlite") for r in made(cols.filter(F.col("source_type") == s), s)]
    assert sorted(made(cols, F.col("source_type"))) == sorted(apart) and len(apart) == 14


def test_a_name_is_cut_into_tokens_once(spark):
    names = spark.createDataFrame([("customer_id",), (None,), ("",), ("Top Line",), ("sku",)], "n string")
    out = names.select("n", glossary.column_terms("n").alias("t"), glossary.column_terms("n", floor=-1.0, k=99).alias("all"))
    rows = {r.n: r for r in out.collect()}
    assert rows[None].t == [] and rows[""].t == [] and rows["Top Line"].t[0] == "Revenue" and {len(r["all"]) for n, r in rows.items() if n is not None} == {len(vocab.SEED_TERMS)}
    plan = names.select(glossary.column_terms("n").alias("t"))._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert plan.count("split(") == 1


def small_lake(spark, folder):
    """Line items and parts with repeated rows, parts without a name or type, and one with columns in many messages."""
    parts = [(1, "red green", "Brand#11", "PROMO", 3), (2, None, "Brand#12", "SMALL", 9), (3, None, "Brand#12", "SMALL", 9), (4, "blue", "Brand#13", None, 5), (5, "x", None, "LARGE", 1), (6, "alone", "Brand#14", "LARGE", 1)]
    spark.createDataFrame([*parts, parts[0]], "p_partkey long, p_name string, p_brand string, p_type string, p_size long").write.parquet(f"{folder}/part.parquet")
    lines = [(o, n, (o * 3 + n) % 5 + 1 if o % 2 else 1, n % 9 / 100.0, float(o % 50 + 1)) for o in range(400) for n in range(1, 8)]
    spark.createDataFrame([*lines, *lines[:30], (7, 1, None, 0.0, 1.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_tax double, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_rows_dealt_out_once_are_grouped_where_they_are(spark, tmp_path):
    lake = small_lake(spark, str(tmp_path / "lake"))
    made = lambda c: assembly.enriched_tables(assembly.enriched_columns(assembly.raw_events(c, "lake", F.col("source_type"), "lake", "run", DAYS[0], limit=50)))
    plain, once = made(derived.columns(spark, lake)), made(derived.columns(spark, lake, lambda r: assembly.dealt(r, 2800)))
    text = lambda df: sorted(r.j for r in df.select(F.to_json(F.struct(*plain.columns)).alias("j")).collect())
    assert text(once) == text(plain) and len(text(once)) == 4
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert (exchanges(plain), exchanges(once)) == (2, 1)


def test_only_narrow_rows_meet_their_assets_in_a_shuffle(spark, tmp_path):
    lake = small_lake(spark, str(tmp_path / "lake"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = derived.columns(spark, lake)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    # what a join makes stands above what it reads
    assert "sample_name" in plan and "sample_name" not in plan.partition("Exchange hashpartitioning(l_partkey")[2].partition("Exchange hashpartitioning(asset_key")[0]


def test_flattened_events_write_enriched_tables_once(spark, tmp_path):
    lake = small_lake(spark, str(tmp_path / "lake"))
    c = derived.columns(spark, lake)
    raw = assembly.raw_events(c.filter(F.col("source_type").isin(*derived.CAT_SOURCES)), "lake", F.col("source_type"), "lake", flow._RUN, flow._EMITTED)
    events = assembly.enriched_tables(assembly.enriched_columns(raw)).withColumn("tables", F.array("t")).drop("t")
    per = {r.asset_id: r for r in assembly.column_rows(events).groupBy("asset_id").agg(F.count(F.lit(1)).alias("columns"), F.count_if(F.col("pii_classification") == "PII").alias("pii"), F.count_distinct("fqn").alias("names")).collect()}
    wanted = {r.fqn: (r.description, r.domain, r.sensitivity_level, r.row_count, r.quality_score, ",".join(sorted(r.suggested_terms)), *per[r.asset_id][1:]) for r in assembly.asset_rows(events).collect()}
    out = flow.f8(spark, lake)
    assert {r.fqn: (r.description, r.domain, r.sensitivity_level, r.row_count, r.quality_score, r.suggested_terms, r.column_count, r.pii, r.names) for r in out.collect()} == wanted and len(wanted) == 3
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
