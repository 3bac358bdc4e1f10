"""Golden values of the example catalog (68 columns, 6 tables) and the 18-edge lineage graph."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakewarden import vocab
from lakewarden.functions import scalars as S
from lakewarden.operators import access, catalog, classification, enrichment, glossary, lineage, profiling, quality
from lakewarden.plans.sample_columns import COLUMNS, TABLES


@pytest.fixture(scope="module")
def mock(spark):
    rows = [(t, TABLES[t][0], i, n, ty, nu, nc, dc, list(sv), TABLES[t][1], TABLES[t][2]) for i, (t, n, ty, nu, nc, dc, sv) in enumerate(COLUMNS)]
    return spark.createDataFrame(rows, "table_name string, schema_name string, ordinal bigint, column_name string, data_type string, is_nullable boolean, null_count bigint, distinct_count bigint, sample_values array<string>, row_count bigint, size_bytes bigint").cache()


def by_key(df):
    return {f"{r.table_name}.{r.column_name}": r for r in df.collect()}


def none(x):
    return None if x in ("-", "–") else x


def test_column_goldens(spark, mock, fixture_tables):
    service = by_key(classification.classify(quality.score_columns(mock)))
    sim = by_key(classification.classify_sim(quality.score_columns(mock, "sim")))
    terms = {}
    for r in glossary.suggest_for_names(mock, glossary.glossary(spark)).orderBy("column_name", "rank").collect():
        terms.setdefault(r.column_name, []).append(f"{r.term} {r.confidence:.3f}".rstrip("0"))
    sim_terms = {r.column_name: r for r in glossary.suggest_sim(mock, glossary.sim_glossary(spark)).filter("rank = 1").collect()}
    rows = fixture_tables["5"][1:]
    assert len(rows) == 68
    for row in rows:
        key = row[0]
        s, m = service[key], sim[key]
        assert (s.completeness, s.uniqueness, s.overall) == tuple(float(x) for x in row[1:4]), key
        assert (s.grade, s.classification, s.category, s.sensitivity_level) == (row[4], none(row[5]), none(row[6]), row[7]), key
        expected = [] if none(row[8]) is None else [t.rstrip("0") for t in row[8].split("; ")]
        assert terms.get(s.column_name, []) == expected, key
        assert m.overall == float(row[9]), key
        assert (m.category, m.sensitivity_level) == (row[10], row[11]), key
        top = sim_terms.get(s.column_name)
        if none(row[12]) is None:
            assert top is None, key
        else:
            name, score = row[12].rsplit(" ", 1)
            assert (top.term, top.score) == (name, float(score)), key


def test_table_goldens(spark, mock, fixture_tables):
    scored = classification.classify(quality.score_columns(mock))
    service = {r.table_name: r for r in quality.score_tables(scored, ["table_name"]).collect()}
    domains = {r.table_name: r.domain for r in enrichment.infer_domains(mock, ["table_name"], "table_name", "column_name", "ordinal").collect()}
    promoted = {r.table_name: r.sensitivity_level for r in classification.table_sensitivity(scored, ["table_name"], "service").collect()}
    highest = {r.table_name: r.sensitivity_level for r in classification.table_sensitivity(scored, ["table_name"], "max").collect()}
    sim_scored = classification.classify_sim(quality.score_columns(mock, "sim"))
    sim = {r.table_name: r for r in quality.score_tables(sim_scored, ["table_name"], "sim").collect()}
    sim_level = {r.table_name: r.sensitivity_level for r in classification.table_sensitivity(sim_scored, ["table_name"], "max").collect()}
    sim_pii = {r.table_name: r.pii_column_count for r in classification.pii_counts(sim_scored, ["table_name"]).collect()}
    sim_dom = {r.table_name: r.d for r in mock.select("table_name", enrichment.sim_domain("schema_name", "table_name").alias("d")).distinct().collect()}
    ranked = mock.join(glossary.suggest_sim(mock, glossary.sim_glossary(spark)), "column_name")
    terms = {r.table_name: ", ".join(r.business_terms) for r in glossary.asset_terms(ranked, ["table_name"]).collect()}
    for row in fixture_tables["6"][1:]:
        t = row[0].split(".")[1]
        r = service[t]
        assert (r.column_count, r.completeness, r.uniqueness) == (int(row[3]), float(row[4]), float(row[5]))
        assert f"{r.overall} {r.grade}" == row[6]
        assert (domains[t], promoted[t], highest[t]) == tuple(row[7:10])
        assert f"{sim[t].overall} {sim[t].grade}" == row[10]
        assert (sim_dom[t], sim_level[t], sim_pii[t], terms[t]) == (row[11], row[12], int(row[13]), row[14])


def test_summary_totals(spark, mock):
    sim = classification.classify_sim(quality.score_columns(mock, "sim")).withColumn("asset_id", F.col("table_name"))
    tables = quality.score_tables(sim, ["table_name"], "sim").withColumnRenamed("grade", "quality_grade")
    levels = classification.table_sensitivity(sim, ["table_name"], "max")
    sizes = mock.groupBy("table_name").agg(F.first("row_count").alias("row_count"), F.first("size_bytes").alias("size_bytes"))
    assets = tables.join(levels, "table_name").join(sizes, "table_name").withColumn("asset_id", F.col("table_name")).drop("column_count")
    counts = classification.pii_counts(sim, ["asset_id"])
    got = {r.measure: r.value for r in catalog.summary_report(assets, counts).collect()}
    assert (got["tables"], got["rows"], got["bytes"], got["columns"], got["pii_columns"]) == (6, 111_897_455, 45_356_200_000, 68, 23)
    assert (got["grade_B"], got["grade_C"], got["level_RESTRICTED"], got["level_CONFIDENTIAL"], got["level_PUBLIC"]) == (5, 1, 3, 1, 2)


@pytest.mark.parametrize("name,samples,expected", [
    ("email_address", ["not-an-email"], ("PII", "ADDRESS", "CONFIDENTIAL")),
    ("email_address", [], ("PII", "EMAIL", "CONFIDENTIAL")),
    ("ssn", ["abc"], (None, None, "PUBLIC")),
    ("secret_note", [], ("PII", "AUTH_TOKEN", "RESTRICTED")),
    ("is_private", [], ("SENSITIVE", None, "INTERNAL")),
    ("customer_email", ["john@example.com"], ("PII", "EMAIL", "CONFIDENTIAL")),
    ("card_number", ["4111111111111111"], ("PII", "CREDIT_CARD", "RESTRICTED")),
    ("card_number", ["4532-1234-5678-9010"], (None, None, "PUBLIC")),
    ("SSN", [""], (None, None, "PUBLIC")),
])
def test_classification_points(spark, name, samples, expected):
    df = spark.createDataFrame([(name, samples)], "column_name string, sample_values array<string>")
    r = classification.classify(df).first()
    assert (r.classification, r.category, r.sensitivity_level) == expected


def test_null_samples_count_as_none(spark):
    df = spark.createDataFrame([("email", None)], "column_name string, sample_values array<string>")
    assert classification.classify(df).first().category == "EMAIL"


def test_scalar_points(spark):
    r = spark.range(1).select(
        S.luhn_ok(F.lit("4111111111111111")).alias("a"), S.luhn_ok(F.lit("4532-1234-5678-9010")).alias("b"), S.luhn_ok(F.lit("411111111111")).alias("c"), S.luhn_ok(F.lit("0")).alias("z"),
        S.mask_email(F.lit("john.smith@email.com")).alias("m"), S.title_case(F.lit("address line1 it's ab1cd")).alias("t"),
        S.human_bytes(F.lit(1843200000)).alias("s"), S.human_rows(F.lit(4823901)).alias("n"),
        S.dataset_urn(F.lit("teradata"), F.lit("a.b")).alias("u"), S.fqn_schema(F.lit("a.b.c")).alias("p"), S.fqn_schema(F.lit("a")).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.z) == (True, False, False, False)
    assert r.m == "jo***@email.com"
    assert r.t == "Address Line1 It'S Ab1Cd"
    assert (r.s, r.n) == ("1.7 GB", "4.82M")
    assert r.u == "urn:li:dataset:(urn:li:dataPlatform:teradata,a.b,PROD)"
    assert (r.p, r.e) == ("a.b", "")


@pytest.mark.parametrize("name,table,expected", [
    ("customer_id", None, [("Customer", 0.167), ("KYC", 0.167)]),
    ("customer_id", "customers", [("Customer", 0.143), ("KYC", 0.143)]),
    ("Revenue", None, [("Revenue", 1.0)]),
    ("client", None, [("Customer", 0.467)]),
])
def test_term_points(spark, name, table, expected):
    df = spark.createDataFrame([(name, table)], "column_name string, table_name string")
    out = glossary.suggest_for_names(df, glossary.glossary(spark), table_col="table_name" if table else None).orderBy("rank").collect()
    assert [(r.term, r.confidence) for r in out][: len(expected)] == expected


def test_estimates(spark):
    df = spark.createDataFrame([(1001, -0.5, 0.1), (1001, 7.9, 0.0), (0, -0.5, 0.5)], "row_count bigint, n_distinct double, null_frac double")
    assert [(r.distinct_count, r.null_count) for r in profiling.decoded_estimates(df).collect()] == [(500, 100), (7, 0), (0, 0)]


REQUEST = "role string, resource string, action string, blocked boolean, emergency_access boolean, asset_steward string, asset_owner string, user_email string, justification string, sensitivity_level string"


def request(role, resource, action, **ctx):
    return Row(role=role, resource=resource, action=action, blocked=ctx.get("blocked"), emergency_access=ctx.get("emergency"), asset_steward=ctx.get("steward"), asset_owner=ctx.get("owner"), user_email=ctx.get("user"), justification=ctx.get("why"), sensitivity_level=ctx.get("level"))


@pytest.mark.parametrize("req,as_written,intended,rbac", [
    (request("viewer", "asset", "read"), True, True, True),
    (request("viewer", "asset", "read", level="RESTRICTED"), True, False, True),
    (request("data_analyst", "asset", "write"), False, False, False),
    (request("admin", "nothing", "read"), False, False, False),
    (request("guest", "asset", "read"), False, False, False),
    (request(None, "asset", "read"), False, False, False),
    (request("data_steward", "asset", "delete", steward="a", user="a"), True, True, False),
    (request("data_steward", "asset", "delete", steward="a"), False, False, False),
    (request("admin", "user", "read", blocked=True), False, False, True),
    (request("admin", "user", "read", blocked=True, emergency=True), True, True, True),
    (request("admin", "column", "read_pii_value", blocked=True, why="x"), True, True, True),
    (request("admin", "column", "read_pii_value", blocked=True, why=""), False, False, True),
    (request("data_steward", "classification", "override"), True, True, False),
])
def test_policy_points(spark, req, as_written, intended, rbac):
    df = spark.createDataFrame([req], REQUEST)
    assert access.policy_decisions(df).first().allowed is as_written
    assert access.policy_decisions(df, "intended").first().allowed is intended
    assert access.rbac_decisions(df).first().allowed is rbac


def test_permission_matrix(spark):
    m = access.permission_matrix(spark)
    assert m.count() == 4 * sum(len(a) for a in vocab.RBAC_MATRIX.values())
    assert m.filter("role = 'viewer' AND allowed").count() == 3


# ---- lineage ---------------------------------------------------------------
@pytest.fixture(scope="module")
def dag(spark, fixture_tables):
    rows = []
    for i, r in enumerate(x for x in fixture_tables["8"] if len(x) == 8 and x[0] != "source"):
        rows.append((f"e{i:02d}", r[0], r[2], r[4], r[5], int(r[6]), r[1], r[3]))
    return spark.createDataFrame(rows, "edge_id string, source_fqn string, target_fqn string, job_name string, job_type string, n int, source_layer string, target_layer string").cache()


def test_dag_levels_and_impact(spark, dag, fixture_tables):
    expected = [r for r in fixture_tables["8"] if len(r) == 2 and not r[0].startswith("Node")]
    assert len(expected) == 16
    levels, cyclic = lineage.layers_of(dag)
    got = {r.fqn: r.level for r in levels.collect()}
    assert cyclic.count() == 0
    for node, count in expected:
        level, fqn = node.split(" ")
        assert got[fqn] == int(level)
        start = spark.createDataFrame([(fqn,)], "fqn string")
        assert lineage.impact(dag, start).count() == int(count), fqn
    start = spark.createDataFrame([("teradata://FINANCE_DB.CUSTOMER_MASTER",)], "fqn string")
    names = [r.fqn.split(".")[-1] for r in lineage.impact(dag, start).collect()]
    assert names == ["customer_360", "churn_prediction_features", "executive_summary", "risk_dashboard_daily", "stg_customers", "ACCOUNT_SUMMARY"]


def test_dag_summary(spark, dag):
    maps = dag.select("edge_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position"))
    r = lineage.graph_summary(dag, maps).first()
    assert (r.datasets, r.edges, r.column_mappings, r.jobs) == (16, 18, 69, 12)
    assert {x.job_type: x["count"] for x in dag.groupBy("job_type").count().collect()} == {"ELT": 5, "REPORT": 5, "ETL": 4, "ML_TRAINING": 3, "STREAM": 1}


def test_layer_overview_order(spark, dag):
    nodes = dag.select(F.col("source_fqn").alias("fqn"), F.col("source_layer").alias("layer")).union(dag.select("target_fqn", "target_layer")).distinct()
    rows = lineage.layer_overview(dag, nodes).collect()
    assert [r.layer for r in rows] == ["raw", "staging", "curated", "ml_feature", "serving"]
    assert sum(r.nodes for r in rows) == 16
