"""Queries over classification, glossary, enrichment and the catalog store."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars as S
from ..functions.rows import split_parts
from ..operators import catalog, classification, enrichment, glossary, quality
from ..session import scratch_dir
from ..sources.readers import lake
from . import derived as d
from .profiles import LAKE_COLUMNS
from .registry import query

_ID = ("asset_key", "ordinal")


def _classified(spark, root):
    return classification.classify_distinct(d.columns(spark, root))


# ---- D: classification -----------------------------------------------------
@query("d1_name_rule_matches", d.with_ctes("""
    SELECT r.category, count(*) AS matches FROM (SELECT column_name, count(*) AS n FROM cat_columns GROUP BY 1) k
    JOIN rules r ON regexp_matches(lower(k.column_name), r.name_re) JOIN cat_columns c ON c.column_name = k.column_name GROUP BY 1""", "cat_columns", "rules"))
def d1(spark, root):
    """How many columns each name rule finds: conditional counts in one pass."""
    name = F.lower("column_name")
    counts = d.columns(spark, root).agg(*[F.count_if(name.rlike(r.name_re)).alias(r.category) for r in vocab.SERVICE_RULES])
    entries = F.array(*[F.struct(F.lit(r.category).alias("category"), F.col(r.category).alias("matches")) for r in vocab.SERVICE_RULES])
    return counts.select(F.inline(entries)).filter("matches > 0")


@query("d2_value_confirmation", d.with_ctes("""
    SELECT c.column_name, count(*) AS columns, count(*) FILTER (WHERE len(c.sample_values) = 0) AS without_samples,
           count(*) FILTER (WHERE k.classification = 'PII') AS confirmed_pii FROM cat_columns c
    JOIN kind_class k ON k.column_name = c.column_name AND k.sample_values = c.sample_values GROUP BY 1""", "cat_columns", "kind_class"))
def d2(spark, root):
    return _classified(spark, root).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("columns"), F.count_if(F.size("sample_values") == 0).alias("without_samples"), F.count_if(F.col("classification") == "PII").alias("confirmed_pii"))


_RUNS = "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}')) AS run FROM documents"


@query("d3_card_checksums", f"SELECT doc_id, run, {d.luhn_sql('run')} AS is_valid FROM ({_RUNS})")
def d3(spark, root):
    docs = d.table(spark, root, "documents").select("doc_id", "text")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4})"), 1)).alias("run"))
    return runs.withColumn("is_valid", S.luhn_ok("run"))


@query("d4_winning_rule", d.with_ctes("SELECT asset_key, ordinal, category, sensitivity_level FROM classified WHERE category IS NOT NULL", "classified"))
def d4(spark, root):
    return _classified(spark, root).filter(F.col("category").isNotNull()).select(*_ID, "category", "sensitivity_level")


@query("d5_classes", d.with_ctes("SELECT classification, sensitivity_level, count(*) AS columns FROM classified GROUP BY 1, 2", "classified"))
def d5(spark, root):
    return _classified(spark, root).groupBy("classification", "sensitivity_level").agg(F.count(F.lit(1)).alias("columns"))


@query("d6_fallback_words", d.with_ctes("SELECT asset_key, ordinal, column_name, sensitivity_level FROM classified WHERE classification = 'SENSITIVE' AND category IS NULL", "classified"))
def d6(spark, root):
    return _classified(spark, root).filter((F.col("classification") == "SENSITIVE") & F.col("category").isNull()).select(*_ID, "column_name", "sensitivity_level")


@query("d7_classified_columns", d.with_ctes("SELECT asset_fqn, ordinal, column_name, classification, category, sensitivity_level FROM classified", "classified"))
def d7(spark, root):
    return _classified(spark, root).select("asset_fqn", "ordinal", "column_name", "classification", "category", "sensitivity_level")


_HEUR = "CASE " + " ".join(f"WHEN regexp_matches(lower(column_name), {d.q(p)}) THEN {d.q(c)}" for p, c in vocab.HEURISTIC_PII) + " END"
_HWORDS = " OR ".join(f"contains(lower(column_name), {d.q(w)})" for w in vocab.HEURISTIC_SENSITIVE)


@query("d8_heuristic_classes", d.with_ctes(f"SELECT asset_key, ordinal, {_HEUR} AS category, CASE WHEN {_HEUR} IS NOT NULL THEN 'PII' WHEN {_HWORDS} THEN 'SENSITIVE' END AS classification FROM cat_columns", "cat_columns"))
def d8(spark, root):
    return classification.classify_heuristic(d.columns(spark, root)).select(*_ID, "category", "classification")


_SIM_CLASS = f"""sim_rules AS (SELECT * FROM ({d.rules_sql(vocab.SIM_RULES)}) AS t(ord, name_re, value_re, category, lvl, lvl_rank)),
    sim_best AS (SELECT column_name, sample_values, category, lvl FROM (SELECT k.column_name, k.sample_values, r.category, r.lvl,
        row_number() OVER (PARTITION BY k.column_name, k.sample_values ORDER BY r.lvl_rank DESC, r.ord) AS rn FROM kinds k JOIN sim_rules r ON regexp_matches(k.column_name, '(?i)' || r.name_re)
        WHERE len(k.sample_values) = 0 OR len([v for v in k.sample_values if regexp_matches(v, '(?i)' || r.value_re)]) > 0) WHERE rn = 1),
    sim_classified AS (SELECT c.*, coalesce(b.category, 'NONE') AS category, coalesce(b.lvl, 'PUBLIC') AS sensitivity_level FROM cat_columns c
        LEFT JOIN sim_best b ON b.column_name = c.column_name AND b.sample_values = c.sample_values)"""


@query("d9_classified_columns_sim", d.with_ctes(f"WITH {_SIM_CLASS} SELECT asset_key, ordinal, category, sensitivity_level FROM sim_classified", "kinds"))
def d9(spark, root):
    return classification.classify_sim(d.columns(spark, root)).select(*_ID, "category", "sensitivity_level")


@query("d10_table_levels", d.with_ctes(f"""
    SELECT asset_fqn, {d.sql_list(vocab.SENSITIVITY)}[max(CASE classification WHEN 'PII' THEN 3 WHEN 'SENSITIVE' THEN 2 ELSE 0 END) + 1] AS promoted_level,
           {d.sql_list(vocab.SENSITIVITY)}[max(list_position({d.sql_list(vocab.SENSITIVITY)}, sensitivity_level))] AS highest_level FROM classified GROUP BY 1""", "classified"))
def d10(spark, root):
    c = _classified(spark, root).select("asset_fqn", "classification", "sensitivity_level")
    service = classification.table_sensitivity(c, ["asset_fqn"], "service").withColumnRenamed("sensitivity_level", "promoted_level")
    highest = classification.table_sensitivity(c, ["asset_fqn"], "max").withColumnRenamed("sensitivity_level", "highest_level")
    return service.join(highest, "asset_fqn")


@query("d11_pii_assets", d.with_ctes("""
    SELECT a.fqn AS asset_fqn, a.schema_name, a.table_name, a.source_type, a.sensitivity_level AS table_sensitivity, a.data_owner, a.data_steward,
           c.column_name, c.classification, c.category, c.sensitivity_level AS column_sensitivity
    FROM cat_assets a JOIN classified c ON c.asset_id = a.asset_id WHERE c.classification IN ('PII', 'SENSITIVE') AND a.is_active""", "classified"))
def d11(spark, root):
    return classification.pii_assets(d.assets(spark, root), _classified(spark, root))


@query("d12_pii_counts", d.with_ctes("SELECT asset_fqn, count(*) AS column_count, count(*) FILTER (WHERE sensitivity_level <> 'PUBLIC') AS pii_column_count, count(*) FILTER (WHERE sensitivity_level = 'RESTRICTED') AS restricted_count FROM classified GROUP BY 1", "classified"))
def d12(spark, root):
    return classification.pii_counts(_classified(spark, root), ["asset_fqn"])


@query("d12_restricted_columns", d.with_ctes("SELECT asset_fqn, column_name, count(*) AS occurrences FROM classified WHERE sensitivity_level = 'RESTRICTED' GROUP BY 1, 2", "classified"))
def d12_list(spark, root):
    return classification.restricted_columns(_classified(spark, root), ["asset_fqn"])


@query("d13_dashboard", d.with_ctes("SELECT count(*) AS total, count(*) FILTER (WHERE sensitivity_level = 'RESTRICTED') AS restricted, count(*) FILTER (WHERE sensitivity_level = 'CONFIDENTIAL') AS confidential, count(*) FILTER (WHERE classification = 'PII') AS pii FROM classified", "classified"))
def d13(spark, root):
    return classification.dashboard(_classified(spark, root))


@query("d15_category_levels", d.with_ctes(f"""
    SELECT category, {d.sql_case("category", vocab.CATEGORY_LEVEL)} AS default_level, sensitivity_level, count(*) AS columns FROM classified WHERE category IS NOT NULL GROUP BY ALL""", "classified"))
def d15(spark, root):
    """Assigned level against the category's default level."""
    c = _classified(spark, root).filter(F.col("category").isNotNull())
    return c.groupBy("category", classification.default_level("category").alias("default_level"), "sensitivity_level").agg(F.count(F.lit(1)).alias("columns"))


_SCAN_TABLES = {t: [c.split(":")[0] for c in cs.split() if c.endswith(":s")] for t, cs in LAKE_COLUMNS.items() if ":s" in cs}


def _scan_sql(t, c, category, pattern):
    valid = f"CAST(coalesce(sum(len([m for m in regexp_extract_all({c}, {d.q(pattern)}) if {d.luhn_sql('m')}])), 0) AS BIGINT)" if category == "CREDIT_CARD" else "NULL"
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{category}' AS category, CAST(coalesce(sum(len(regexp_extract_all({c}, {d.q(pattern)}))), 0) AS BIGINT) AS hits, "
            f"count(*) FILTER (WHERE regexp_matches({c}, {d.q(pattern)})) AS rows_with_hit, {valid} AS checksum_valid, round(count(*) FILTER (WHERE regexp_matches({c}, {d.q(pattern)})) / count(*), 6) AS match_rate FROM {t}")


@query("d16_value_scan", " UNION ALL ".join(_scan_sql(t, c, cat, p) for t, cs in _SCAN_TABLES.items() for c in cs for cat, p in vocab.VALUE_SCAN))
def d16(spark, root):
    """Every string column of the lake, as the tables' schemas name them."""
    out = None
    for t, df in lake(spark, root).items():
        if cols := [f.name for f in df.schema if f.dataType.simpleString() == "string"]:
            one = classification.value_scan(df, t, cols)
            out = one if out is None else out.unionByName(one)
    return out


_MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


@query("d17_masked_emails", f"SELECT doc_id, regexp_replace(mail, '(.{{2}}).+(@.+)', '\\1***\\2') AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, {d.q(_MAIL)})) AS mail FROM documents)")
def d17(spark, root):
    docs = d.table(spark, root, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_MAIL})"), 1)).alias("mail")).select("doc_id", S.mask_email("mail").alias("masked"))


@query("d17_masked_columns", d.with_ctes("""
    SELECT asset_key, ordinal, CASE WHEN classification IS NOT NULL THEN 'Restricted' END AS shown_classification, CAST(NULL AS VARCHAR) AS shown_category,
           array_to_string([CASE WHEN sensitivity_level NOT IN ('CONFIDENTIAL', 'RESTRICTED') THEN v WHEN contains(v, '@') THEN regexp_replace(v, '(.{2}).+(@.+)', '\\1***\\2')
             ELSE regexp_replace(regexp_replace(regexp_replace(v, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') END for v in sample_values], '|') AS shown_samples FROM classified""", "classified"))
def d17_columns(spark, root):
    """What an analyst sees of every column."""
    shown = classification.mask_for_role(_classified(spark, root), "data_analyst")
    return shown.select(*_ID, "shown_classification", "shown_category", F.array_join("shown_samples", "|").alias("shown_samples"))


# ---- E: glossary -----------------------------------------------------------
def _tok(x: str) -> str:
    return f"list_distinct([lower(t) for t in regexp_split_to_array(regexp_replace({x}, '([A-Z][a-z])', ' \\1', 'g'), '[_\\-\\s]+') if length(t) > 2])"


def _sim_tok(x: str) -> str:
    return f"list_distinct([t for t in regexp_split_to_array(lower(regexp_replace({x}, '([A-Z])', '_\\1', 'g')), '[_\\s\\-]+') if length(t) > 1])"


_TERMS_SQL = "VALUES " + ", ".join(f"({i}, {d.q(t.name)}, {d.q(t.definition)}, {d.q(t.domain)}, CAST({d.sql_list(t.synonyms)} AS VARCHAR[]), CAST({d.sql_list(t.abbreviations)} AS VARCHAR[]))" for i, t in enumerate(vocab.SEED_TERMS, 1))
_TERMS = f"""terms AS (SELECT * FROM ({_TERMS_SQL}) AS t(ord, name, definition, domain, synonyms, abbreviations)),
    bags AS (SELECT *, list_distinct(list_concat(list_concat({_tok("name")}, flatten([{_tok("s")} for s in synonyms])), [lower(a) for a in abbreviations])) AS bag FROM terms)"""


def _suggest_sql(names: str, keys: str, tokens: str) -> str:
    return f"""WITH {_TERMS}, names AS (SELECT DISTINCT {keys} FROM {names}), toks AS (SELECT *, {tokens} AS tk FROM names),
    scored AS (SELECT {keys}, b.ord, b.name, CASE WHEN lower(column_name) = lower(b.name) THEN 1.0::DOUBLE
        WHEN len([s for s in b.synonyms if lower(s) = lower(column_name)]) > 0 THEN least(len(list_intersect(tk, bag)) / len(list_distinct(list_concat(tk, bag))) + 0.3::DOUBLE, 1.0::DOUBLE)
        ELSE len(list_intersect(tk, bag)) / len(list_distinct(list_concat(tk, bag))) END AS score FROM toks CROSS JOIN bags b),
    ranked AS (SELECT {keys}, ord, name AS term, score, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, ord) AS rank FROM scored WHERE score > 0.1::DOUBLE)"""


@query("e1_tokens", d.with_ctes(f"SELECT name, array_to_string(list_sort({_tok('name')}), ' ') AS tokens, count(*) AS uses FROM (SELECT column_name AS name FROM cat_columns UNION ALL SELECT p_name FROM part) GROUP BY 1", "cat_columns"))
def e1(spark, root):
    names = d.columns(spark, root).select(F.col("column_name").alias("name")).unionByName(d.table(spark, root, "part").select(F.col("p_name").alias("name")))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).withColumn("tokens", F.array_join(F.sort_array(S.name_tokens("name")), " "))


@query("e2_tokens_sim", d.with_ctes(f"SELECT name, array_to_string(list_sort({_sim_tok('name')}), ' ') AS tokens, count(*) AS uses FROM (SELECT column_name AS name FROM cat_columns UNION ALL SELECT table_name FROM cat_assets) GROUP BY 1", "cat_columns"))
def e2(spark, root):
    names = d.columns(spark, root).select(F.col("column_name").alias("name")).unionByName(d.assets(spark, root).select(F.col("table_name").alias("name")))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).withColumn("tokens", F.array_join(F.sort_array(S.sim_tokens("name")), " "))


@query("e3_term_bag_hits", d.with_ctes(f"WITH {_TERMS} SELECT b.name AS term, count(*) AS token_hits FROM cat_columns c, unnest({_tok('c.column_name')}) AS u(t) JOIN bags b ON list_contains(b.bag, u.t) GROUP BY 1", "cat_columns"))
def e3(spark, root):
    """How often each term's token bag is hit by column-name tokens: an equi-join on the token."""
    per_token = d.columns(spark, root).select(F.explode(S.name_tokens("column_name")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    bags = glossary.token_bag(glossary.glossary(spark)).select(F.col("name").alias("term"), F.explode("bag").alias("token"))
    return per_token.join(bags, "token").groupBy("term").agg(F.sum("n").alias("token_hits"))


@query("e4_term_scores", d.with_ctes(_suggest_sql("cat_columns", "column_name, table_name", f"list_distinct(list_concat({_tok('column_name')}, {_tok('table_name')}))") + " SELECT column_name, table_name, term, nearest(score, 3) AS confidence, rank FROM ranked WHERE rank <= 5", "cat_columns"))
def e4(spark, root):
    """Suggestions from column and table name together."""
    c = d.columns(spark, root)
    return glossary.suggest_for_names(c, glossary.glossary(spark), table_col="table_name").withColumn("rank", F.col("rank").cast("bigint"))


@query("e5_exact_name_boosts", _suggest_sql("(SELECT DISTINCT name AS column_name FROM (SELECT ['Revenue', 'client', 'SKU', 'Top Line', 'order id', 'tax'][p_size % 6 + 1] AS name FROM part UNION ALL SELECT p_name FROM part))", "column_name", _tok("column_name")) + " SELECT column_name, term, nearest(score, 3) AS confidence, rank FROM ranked WHERE rank <= 5")
def e5(spark, root):
    p = d.table(spark, root, "part")
    names = p.select(d.pick(("Revenue", "client", "SKU", "Top Line", "order id", "tax"), F.col("p_size") % 6).alias("column_name")).unionByName(p.select(F.col("p_name").alias("column_name")))
    return glossary.suggest_for_names(names, glossary.glossary(spark)).withColumn("rank", F.col("rank").cast("bigint"))


TERM_RANKS_SQL = _suggest_sql("cat_columns", "column_name", _tok("column_name"))


@query("e6_suggested_terms", d.with_ctes(TERM_RANKS_SQL + " SELECT c.asset_key, c.ordinal, term, nearest(score, 3) AS confidence, rank FROM ranked r JOIN cat_columns c ON c.column_name = r.column_name WHERE rank <= 5", "cat_columns"))
def e6(spark, root):
    c = d.columns(spark, root).select(*_ID, "column_name")
    return glossary.suggest_terms(c, glossary.glossary(spark)).select(*_ID, "term", "confidence", F.col("rank").cast("bigint").alias("rank"))


_SIM_TERMS_SQL = "VALUES " + ", ".join(f"({i}, {d.q(n)}, {d.sql_list((n, *s))})" for i, (n, s) in enumerate(vocab.SIM_TERMS, 1))
_SIM_SUGGEST = f"""WITH st AS (SELECT * FROM ({_SIM_TERMS_SQL}) AS t(ord, name, labels)), names AS (SELECT DISTINCT column_name FROM cat_columns), toks AS (SELECT column_name, {_sim_tok("column_name")} AS tk FROM names),
    labels AS (SELECT ord, name, i, labels[i] AS label, {_sim_tok("labels[i]")} AS lt FROM st, unnest(range(1, len(labels) + 1)) AS u(i)),
    fuzzy AS (SELECT column_name, ord, name, arg_min(s, i) AS s FROM (SELECT column_name, ord, name, i, CASE WHEN len(list_concat(tk, lt)) = 0 THEN 0 ELSE len(list_intersect(tk, lt)) / len(list_distinct(list_concat(tk, lt))) END AS s FROM toks CROSS JOIN labels) WHERE s >= 0.2 GROUP BY 1, 2, 3),
    kinds_ AS (SELECT column_name, ord, name, CASE WHEN lower(column_name) = replace(lower(name), ' ', '_') THEN 'exact' WHEN len([l for l in labels[2:] if lower(l) = lower(column_name)]) > 0 THEN 'synonym' END AS kind FROM names CROSS JOIN st),
    all_ AS (SELECT k.column_name, k.ord, k.name AS term, CASE kind WHEN 'exact' THEN 1.0::DOUBLE WHEN 'synonym' THEN 0.99::DOUBLE ELSE nearest(f.s, 4) END AS score, coalesce(kind, 'fuzzy') AS match_type
        FROM kinds_ k LEFT JOIN fuzzy f ON f.column_name = k.column_name AND f.ord = k.ord WHERE kind IS NOT NULL OR f.s IS NOT NULL),
    sim_ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY score DESC, ord) AS rank FROM all_)"""


@query("e7_suggested_terms_sim", d.with_ctes(_SIM_SUGGEST + " SELECT column_name, term, score, match_type, rank FROM sim_ranked WHERE rank <= 3", "cat_columns"))
def e7(spark, root):
    return glossary.suggest_sim(d.columns(spark, root), glossary.sim_glossary(spark)).withColumn("rank", F.col("rank").cast("bigint"))


@query("e8_term_search", d.with_ctes(f"WITH {_TERMS} SELECT a.fqn, b.name AS term FROM cat_assets a JOIN terms b ON b.domain = a.domain AND (contains(lower(b.name), 'id') OR contains(lower(b.definition), 'id') OR len([s for s in b.synonyms if contains(lower(s), 'id')]) > 0)", "cat_assets"))
def e8(spark, root):
    """Terms found by a text search, joined to the assets of their domain."""
    hits = glossary.search_terms(glossary.glossary(spark), q="ID", status="ACTIVE").select("domain", F.col("name").alias("term"))
    return d.assets(spark, root).select("fqn", "domain").join(hits, "domain").select("fqn", "term")


@query("e8_term_page", d.with_ctes(f"""WITH {_TERMS}, hits AS (SELECT a.fqn, b.name AS term FROM cat_assets a JOIN terms b ON b.domain = a.domain AND (contains(lower(b.name), 'id') OR contains(lower(b.definition), 'id') OR len([s for s in b.synonyms if contains(lower(s), 'id')]) > 0))
    SELECT fqn, term, (SELECT count(*) FROM hits) AS total, CAST(ceil((SELECT count(*) FROM hits) / 20.0) AS BIGINT) AS total_pages FROM hits ORDER BY fqn, term LIMIT 20 OFFSET 40""", "cat_assets"))
def e8_page(spark, root):
    """The third page of the assets whose domain has a term with the text, with the total before paging."""
    hits = glossary.search_terms(glossary.glossary(spark), q="ID", status="ACTIVE").select("domain", F.col("name").alias("term"))
    found = d.assets(spark, root).select("fqn", "domain").join(hits, "domain").select("fqn", "term")
    return catalog.page(found, [F.col("fqn"), F.col("term")], 20, 40)


@query("e9_term_assignments", d.with_ctes("SELECT term_id, CASE WHEN CAST(substr(term_id, 6) AS INT) BETWEEN 1 AND 15 THEN 'accepted' ELSE 'rejected' END AS state, count(*) AS assignments FROM (SELECT 'term-' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS term_id FROM lineitem) GROUP BY 1, 2"))
def e9(spark, root):
    """Assignments split by whether the term exists."""
    li = d.table(spark, root, "lineitem").select(F.concat(F.lit("term-"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0")).alias("term_id"))
    accepted, rejected = glossary.split_assignments(li, glossary.glossary(spark))
    both = accepted.withColumn("state", F.lit("accepted")).unionByName(rejected.withColumn("state", F.lit("rejected")))
    return both.groupBy("term_id", "state").agg(F.count(F.lit(1)).alias("assignments"))


_FIELDS = ("view", "click", "purchase", "signup", "error")


@query("e10_term_lifecycle", "SELECT user_id, " + ", ".join(f"arg_max(CASE WHEN event_type = '{f}' THEN value END, ts) FILTER (WHERE event_type = '{f}') AS \"{f}\"" for f in _FIELDS) + ", max(ts) AS updated_at, count(*) AS update_count FROM events GROUP BY 1")
def e10(spark, root):
    """Update log folded to the current state of every term (user = term, event type = field)."""
    return glossary.fold_updates(d.events(spark, root), "user_id", "event_type", "value", ["ts", "event_id"], _FIELDS)


_TERM_CHANGES = {"view": "definition", "click": "domain", "purchase": "status", "signup": "owner", "error": "status"}
_TERM_VALUES = """CASE event_type WHEN 'view' THEN 'definition ' || event_id WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'finance' ELSE 'customer' END
    WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'GONE' ELSE 'ACTIVE' END WHEN 'error' THEN 'DEPRECATED' ELSE 'x' END"""


@query("e10_term_status", f"""WITH {_TERMS}, log AS (SELECT 'term-' || lpad(CAST(user_id % 20 AS VARCHAR), 3, '0') AS term_id, {d.sql_case("event_type", _TERM_CHANGES)} AS field, {_TERM_VALUES} AS value, ts, event_id FROM events),
    ok AS (SELECT * FROM log WHERE field IN ('definition', 'domain') OR (field = 'status' AND value IN ('DRAFT', 'ACTIVE', 'DEPRECATED'))),
    last AS (SELECT term_id, {", ".join(f"arg_max(value, (ts, event_id)) FILTER (WHERE field = '{f}') AS {f}" for f in ("definition", "domain", "status"))}, max(ts) AS updated_at, count(*) AS update_count FROM ok GROUP BY 1)
    SELECT t.term_id, t.name, coalesce(l.definition, t.definition) AS definition, coalesce(l.domain, t.domain) AS domain, coalesce(l.status, 'ACTIVE') AS status, updated_at, coalesce(update_count, 0) AS update_count
    FROM (SELECT 'term-' || lpad(CAST(ord AS VARCHAR), 3, '0') AS term_id, * FROM terms) t LEFT JOIN last l USING (term_id)""")
def e10_status(spark, root):
    """The glossary after an update log of the events' size: fields and states change, unknown ones do not."""
    e = d.events(spark, root)
    field = F.try_element_at(F.create_map(*[F.lit(x) for kv in _TERM_CHANGES.items() for x in kv]), F.col("event_type"))
    log = e.select(F.concat(F.lit("term-"), F.lpad((F.col("user_id") % 20).cast("string"), 3, "0")).alias("term_id"), field.alias("field"), F.expr(_TERM_VALUES).alias("value"), "ts", F.col("event_id").alias("seq"))
    return glossary.apply_updates(glossary.glossary(spark), log).select("term_id", "name", "definition", "domain", "status", "updated_at", "update_count")


TABLE_TERMS_SQL = "list_distinct(flatten([" + ", ".join(f"CASE WHEN list_contains(string_split(lower(table_name), '_'), {d.q(w)}) THEN {d.sql_list(ts)} ELSE CAST([] AS VARCHAR[]) END" for w, ts in vocab.TABLE_TERMS.items()) + "])[1:5])"


@query("e11_table_terms", d.with_ctes(f"SELECT fqn, array_to_string(list_sort({TABLE_TERMS_SQL}), ', ') AS terms FROM cat_assets", "cat_assets"))
def e11(spark, root):
    return d.assets(spark, root).select("fqn", F.array_join(F.sort_array(glossary.table_terms(F.col("table_name"))), ", ").alias("terms"))


@query("e12_asset_terms", d.with_ctes(_SIM_SUGGEST + " SELECT asset_fqn, string_agg(DISTINCT term, ', ' ORDER BY term) AS business_terms FROM cat_columns c JOIN sim_ranked r ON r.column_name = c.column_name AND rank = 1 GROUP BY 1", "cat_columns"))
def e12(spark, root):
    c = d.columns(spark, root).select("asset_fqn", "column_name")
    ranked = c.join(glossary.suggest_sim(c, glossary.sim_glossary(spark)), "column_name")
    return glossary.asset_terms(ranked, ["asset_fqn"]).withColumn("business_terms", F.array_join("business_terms", ", "))


@query("e13_term_usage", d.with_ctes(f"SELECT term, count(*) AS asset_count FROM (SELECT unnest({TABLE_TERMS_SQL}) AS term FROM cat_assets) GROUP BY 1", "cat_assets"))
def e13(spark, root):
    return glossary.term_usage(d.assets(spark, root).select(glossary.table_terms(F.col("table_name")).alias("suggested_terms")))


# ---- F: enrichment ---------------------------------------------------------
@query("f1_fqn_formats", d.with_ctes("""
    SELECT fqn, source_type || '://' || schema_name || '.' || table_name AS uri_fqn, source_type || '://HOST-01/' || schema_name || '/' || table_name AS host_fqn,
           source_type || '.lake.' || schema_name || '.' || table_name AS database_fqn, table_name AS label, source_type || '.' || schema_name AS parent FROM cat_assets""", "cat_assets"))
def f1(spark, root):
    a = d.assets(spark, root)
    return a.select(
        "fqn", S.uri_fqn("source_type", "schema_name", "table_name").alias("uri_fqn"), S.host_fqn("source_type", F.lit("HOST-01"), "schema_name", "table_name").alias("host_fqn"),
        S.database_fqn("source_type", "database_name", "schema_name", "table_name").alias("database_fqn"), S.fqn_label("fqn").alias("label"), S.fqn_schema("fqn").alias("parent"))


DOMAIN_SCORES_SQL = ", ".join(
    f"({i}, {d.q(dom)}, " + " + ".join(f"CAST(regexp_matches(txt, {d.q(p)}) AS INT)" for p in pats) + ")" for i, (dom, pats) in enumerate(vocab.DOMAIN_PATTERNS.items()))


@query("f2_domains", d.with_ctes(f"""
    , texts AS (SELECT asset_fqn, lower(any_value(table_name)) || ' ' || string_agg(lower(column_name), ' ' ORDER BY ordinal) AS txt FROM cat_columns GROUP BY 1),
    scores AS (SELECT asset_fqn, v.* FROM texts, LATERAL (VALUES {DOMAIN_SCORES_SQL}) AS v(ord, domain, score))
    SELECT t.asset_fqn, s.domain FROM texts t LEFT JOIN (SELECT asset_fqn, domain FROM (SELECT *, row_number() OVER (PARTITION BY asset_fqn ORDER BY score DESC, ord) AS rn FROM scores WHERE score > 0) WHERE rn = 1) s ON s.asset_fqn = t.asset_fqn""".replace("\n    , texts", "WITH texts", 1), "cat_columns"))
def f2(spark, root):
    return enrichment.infer_domains(d.columns(spark, root), ["asset_fqn"], "table_name", "column_name", "ordinal")


_F3_SCORES = ", ".join(f"({i}, {d.q(dom)}, " + " + ".join(f"CAST(contains(txt, {d.q(w)}) AS INT)" for w in words) + ")" for i, (dom, words) in enumerate(vocab.SIM_DOMAIN_WORDS.items()))


@query("f3_domains_sim", d.with_ctes(f"""
    , texts AS (SELECT fqn, lower(schema_name || ' ' || table_name) AS txt FROM cat_assets), scores AS (SELECT fqn, v.* FROM texts, LATERAL (VALUES {_F3_SCORES}) AS v(ord, domain, score))
    SELECT t.fqn, coalesce(s.domain, 'general') AS domain FROM texts t LEFT JOIN (SELECT fqn, domain FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY score DESC, ord) AS rn FROM scores WHERE score > 0) WHERE rn = 1) s ON s.fqn = t.fqn""".replace("\n    , texts", "WITH texts", 1), "cat_assets"))
def f3(spark, root):
    return d.assets(spark, root).select("fqn", enrichment.sim_domain("schema_name", "table_name").alias("domain"))


def title_sql(x: str) -> str:
    return f"array_to_string([upper(w[1]) || lower(w[2:]) for w in regexp_extract_all(regexp_replace({x}, '[_\\-]', ' ', 'g'), '[A-Za-z]+|[^A-Za-z]+')], '')"


_BLANK = f"(description IS NULL OR trim(lower(description)) IN ({', '.join(d.q(b) for b in vocab.BLANK_DESCRIPTIONS)}))"


@query("f4_column_descriptions", d.with_ctes(f"SELECT asset_key, ordinal, CASE WHEN {_BLANK} THEN 'The ' || {title_sql('column_name')} || ' field (' || data_type || '). Auto-generated — please review.' ELSE description END AS description FROM cat_columns", "cat_columns"))
def f4(spark, root):
    return d.columns(spark, root).select(*_ID, enrichment.column_description("description", "column_name", "data_type").alias("description"))


@query("f5_table_descriptions", d.with_ctes(f"""
    , firsts AS (SELECT *, row_number() OVER (PARTITION BY asset_fqn ORDER BY ordinal, column_name) AS rn FROM cat_columns)
    SELECT asset_fqn, {title_sql("any_value(table_name)")} || ' contains records from the ' || any_value(schema_name) || ' schema. Key columns include: ' || string_agg(column_name, ', ' ORDER BY rn)
        || '. Auto-generated — please enrich via the Data Catalog UI.' AS description FROM firsts WHERE rn <= 5 GROUP BY 1""".replace("\n    , firsts", "WITH firsts", 1), "cat_columns"))
def f5(spark, root):
    return enrichment.table_descriptions(d.columns(spark, root), ["asset_fqn"], "schema_name", "table_name", "column_name", ["ordinal", "column_name"])


@query("f6_asset_ids", d.with_ctes("SELECT fqn, 'asset-' || substr(md5(fqn), 1, 12) AS asset_id FROM cat_assets", "cat_assets"))
def f6(spark, root):
    return enrichment.identify(d.assets(spark, root).drop("fqn", "asset_id")).select("fqn", "asset_id")


@query("f7_asset_documents", d.with_ctes("""
    , limits AS (SELECT asset_fqn, count(*) AS n FROM cat_columns GROUP BY 1),
    parted AS (SELECT s.*, k.classification, CASE WHEN n > 20 THEN CAST('0x' || substr(md5(CAST(s.ordinal AS VARCHAR)), 1, 8) AS BIGINT) % CAST(ceil(n / 20.0) AS BIGINT) ELSE 0 END AS part
        FROM scored s JOIN limits USING (asset_fqn) JOIN kind_class k ON k.column_name = s.column_name AND k.sample_values = s.sample_values)
    SELECT asset_fqn, part, count(*) AS column_count, string_agg(column_name || ':' || grade || ':' || coalesce(classification, '-'), ',' ORDER BY ordinal, column_name, grade) AS columns FROM parted GROUP BY 1, 2""".replace("\n    , limits", "WITH limits", 1), "scored", "kind_class"))
def f7(spark, root):
    """Assets assembled with their scored and classified columns, in bounded parts."""
    c = quality.score_columns(_classified(spark, root)).select("asset_fqn", "ordinal", "column_name", "grade", "classification")
    doc = enrichment.column_documents(c, ["asset_fqn"], "ordinal", ["column_name", "grade", "classification"], limit=20)
    item = lambda s: F.concat_ws(":", s.column_name, s.grade, F.coalesce(s.classification, F.lit("-")))
    return doc.select("asset_fqn", "part", "column_count", F.array_join(F.transform("columns", item), ",").alias("columns"))


@query("f9_readable_sizes", d.with_ctes("""
    SELECT fqn, CASE WHEN size_bytes < 1024 THEN format('{:.1f} B', round_even(size_bytes::DOUBLE, 1)) WHEN size_bytes < 1048576 THEN format('{:.1f} KB', round_even(size_bytes / 1024.0::DOUBLE, 1))
        WHEN size_bytes < 1073741824 THEN format('{:.1f} MB', round_even(size_bytes / 1048576.0::DOUBLE, 1)) ELSE format('{:.1f} GB', round_even(size_bytes / 1073741824.0::DOUBLE, 1)) END AS size,
        CASE WHEN row_count >= 1000000 THEN format('{:.2f}M', round_even(row_count / 1000000.0::DOUBLE, 2)) WHEN row_count >= 1000 THEN format('{:.1f}K', round_even(row_count / 1000.0::DOUBLE, 1)) ELSE CAST(row_count AS VARCHAR) END AS rows FROM cat_assets""", "cat_assets"))
def f9(spark, root):
    return d.assets(spark, root).select("fqn", S.human_bytes("size_bytes").alias("size"), S.human_rows("row_count").alias("rows"))


# ---- G: catalog ------------------------------------------------------------
def _batch(spark, root):
    """A later hydration: the assets of two schemas measured again, and as many new ones."""
    a = d.assets(spark, root).filter(F.col("schema_name").isin("ECONOMY", "SMALL"))
    again = a.withColumns({"row_count": F.col("row_count") + 5, "quality_score": F.col("quality_score") / 2, "quality_grade": S.grade_of(F.col("quality_score") / 2), "description": F.lit("from the batch"), "data_owner": F.lit("nobody"), "updated_at": F.col("updated_at") + F.expr("INTERVAL 400 DAYS")})
    new = again.withColumn("fqn", F.concat("fqn", F.lit("_new"))).withColumn("asset_id", S.asset_id("fqn"))
    return again.unionByName(new)


_G_COLS = "fqn, asset_id, description, domain, data_owner, row_count, quality_score, quality_grade, updated_at"
_BATCH_SQL = f"""again AS (SELECT fqn, asset_id, 'from the batch' AS description, domain, 'nobody' AS data_owner, row_count + 5 AS row_count, quality_score / 2 AS quality_score,
        {d.grade_sql("quality_score / 2")} AS quality_grade, updated_at + INTERVAL 400 DAY AS updated_at FROM cat_assets WHERE schema_name IN ('ECONOMY', 'SMALL')),
    batch AS (SELECT * FROM again UNION ALL SELECT fqn || '_new', 'asset-' || substr(md5(fqn || '_new'), 1, 12), description, domain, data_owner, row_count, quality_score, quality_grade, updated_at FROM again)"""


@query("g1_asset_upsert", d.with_ctes(f"""WITH {_BATCH_SQL}
    SELECT a.fqn, a.asset_id, a.description, a.domain, a.data_owner, coalesce(b.row_count, a.row_count) AS row_count, coalesce(b.quality_score, a.quality_score) AS quality_score,
           coalesce(b.quality_grade, a.quality_grade) AS quality_grade, coalesce(b.updated_at, a.updated_at) AS updated_at FROM cat_assets a LEFT JOIN batch b ON b.fqn = a.fqn
    UNION ALL SELECT {_G_COLS} FROM batch WHERE fqn NOT IN (SELECT fqn FROM cat_assets)""", "cat_assets"))
def g1(spark, root):
    cols = _G_COLS.split(", ")
    return catalog.upsert_assets(d.assets(spark, root).select(*cols), _batch(spark, root).select(*cols))


@query("g2_column_replacement", d.with_ctes("""
    SELECT asset_fqn, count(*) AS columns, CAST(sum(null_count) AS BIGINT) AS nulls FROM (
      SELECT asset_fqn, null_count FROM cat_columns WHERE asset_fqn NOT IN (SELECT DISTINCT asset_fqn FROM cat_columns WHERE source_type IN ('mssql', 'sqlite') AND line <= 3)
      UNION ALL SELECT asset_fqn, null_count + 1 FROM cat_columns WHERE source_type IN ('mssql', 'sqlite') AND line <= 3) GROUP BY 1""", "cat_columns"))
def g2(spark, root):
    c = d.columns(spark, root).select("asset_fqn", "source_type", "line", "column_name", "null_count")
    batch = c.filter(F.col("source_type").isin("mssql", "sqlite") & (F.col("line") <= 3)).withColumn("null_count", F.col("null_count") + 1)
    return catalog.replace_columns(c, batch).groupBy("asset_fqn").agg(F.count(F.lit(1)).alias("columns"), F.sum("null_count").alias("nulls"))


_G3 = "is_active AND domain = 'product' AND (contains(lower(fqn), 'bolt') OR contains(lower(description), 'bolt') OR contains(lower(table_name), 'bolt') OR contains(lower(schema_name), 'bolt'))"


@query("g3_search", d.with_ctes(f"SELECT fqn, quality_score, (SELECT count(*) FROM cat_assets WHERE {_G3}) AS total, CAST(ceil((SELECT count(*) FROM cat_assets WHERE {_G3}) / 10.0) AS BIGINT) AS total_pages FROM cat_assets WHERE {_G3} ORDER BY updated_at DESC, fqn LIMIT 10 OFFSET 2", "cat_assets"))
def g3(spark, root):
    """One page of a text search with filters and the total beside it."""
    found = catalog.search_page(d.assets(spark, root), limit=10, offset=2, q="Bolt", domain="product")
    return found.select("fqn", "quality_score", "total", "total_pages")


@query("g3_search_all", d.with_ctes("SELECT fqn FROM cat_assets WHERE is_active AND sensitivity_level = 'RESTRICTED' AND source_type = 'mssql' AND (lower(fqn) LIKE '%e_gear%' OR lower(description) LIKE '%e_gear%' OR lower(table_name) LIKE '%e_gear%' OR lower(schema_name) LIKE '%e_gear%')", "cat_assets"))
def g3_all(spark, root):
    return catalog.search(d.assets(spark, root), q="e_gear", sensitivity="restricted", source_type="mssql", like=True).select("fqn")


@query("g3_search_documents", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') AND lang = 'en'")
def g3_docs(spark, root):
    return d.table(spark, root, "documents").filter(F.lower("text").contains("the") & (F.col("lang") == "en")).select("doc_id", "n_chars")




@query("g4_asset_with_columns", d.with_ctes("SELECT a.asset_id, a.fqn, a.domain, a.sensitivity_level, a.quality_grade, c.column_name, c.data_type, c.null_count, c.distinct_count FROM cat_assets a LEFT JOIN cat_columns c ON c.asset_fqn = a.fqn WHERE a.asset_key = 7", "cat_columns"))
def g4(spark, root):
    a = d.assets(spark, root)
    fqn = a.filter("asset_key = 7").select("fqn").first()["fqn"]
    return catalog.asset_with_columns(a, d.columns(spark, root), fqn)


def _patches(spark, root):
    li = d.table(spark, root, "lineitem")
    a = d.assets(spark, root).select("asset_key", "fqn")
    field = d.pick(("description", "data_owner", "row_count", "domain", "data_steward", "quality_score"), F.col("l_suppkey") % 6)
    return li.join(a, F.col("l_partkey") == F.col("asset_key")).select(
        "fqn", field.alias("field"), F.concat(F.lit("v"), F.col("l_orderkey")).alias("value"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


def _patched(f: str) -> str:
    return f"coalesce(arg_max(p.value, (p.ts, p.seq)) FILTER (WHERE p.field = '{f}'), any_value(a.{f})) AS {f}"


@query("g5_steward_patches", d.with_ctes(f"""
    , patches AS (SELECT fqn, ['description', 'data_owner', 'row_count', 'domain', 'data_steward', 'quality_score'][l_suppkey % 6 + 1] AS field, 'v' || l_orderkey AS value, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS seq
        FROM lineitem JOIN cat_assets ON asset_key = l_partkey)
    SELECT a.fqn, {_patched("description")}, {_patched("data_owner")}, {_patched("data_steward")}, {_patched("domain")}, any_value(a.row_count) AS row_count,
           coalesce(max(p.ts), any_value(a.updated_at)) AS updated_at FROM cat_assets a LEFT JOIN patches p ON p.fqn = a.fqn AND p.field IN ('description', 'data_owner', 'data_steward', 'domain') GROUP BY a.fqn""".replace("\n    , patches", "WITH patches", 1), "cat_assets"))
def g5(spark, root):
    out = catalog.apply_patches(d.assets(spark, root), _patches(spark, root))
    return out.select("fqn", "description", "data_owner", "data_steward", "domain", "row_count", "updated_at")


@query("g6_schema_migration", d.with_ctes("SELECT fqn, quality_score, CASE WHEN is_active THEN 1.0::DOUBLE END AS quality_validity FROM cat_assets", "cat_assets"))
def g6(spark, root):
    """Old files without a column and new files with it read as one table."""
    path = scratch_dir(spark, "migration")
    a = d.assets(spark, root).select("is_active", "fqn", "quality_score")
    a.filter("NOT is_active").write.parquet(f"{path}/v=1")
    a.filter("is_active").withColumn("quality_validity", F.lit(1.0)).write.parquet(f"{path}/v=2")
    old, new = (spark.read.parquet(f"{path}/v={v}") for v in (1, 2))
    return catalog.migrate(old, new).select("fqn", "quality_score", "quality_validity")


@query("g7_active_assets", d.with_ctes("SELECT count(*) AS active_assets FROM cat_assets WHERE is_active", "cat_assets"))
def g7(spark, root):
    return catalog.active_count(d.assets(spark, root))


_G8_ROW = "count(*) AS asset_count, count(*) FILTER (WHERE has_pii) AS assets_with_pii, round(CAST(sum(CAST(quality_score AS DECIMAL(28, 4))) AS DOUBLE) / count(quality_score), 6) AS avg_quality FROM act"


@query("g8_catalog_stats", d.with_ctes(f"""
    , act AS (SELECT *, asset_id IN (SELECT asset_id FROM classified WHERE classification = 'PII') AS has_pii FROM cat_assets WHERE is_active)
    SELECT 'total' AS dimension, 'all' AS member, {_G8_ROW} UNION ALL SELECT 'domain', coalesce(domain, 'none'), {_G8_ROW} GROUP BY 2
    UNION ALL SELECT 'sensitivity', sensitivity_level, {_G8_ROW} GROUP BY 2 UNION ALL SELECT 'source', source_type, {_G8_ROW} GROUP BY 2""".replace("\n    , act", "WITH act", 1), "classified"))
def g8(spark, root):
    return catalog.stats(d.assets(spark, root), _classified(spark, root))


@query("g9_json_tags", d.with_ctes("SELECT fqn, tags ->> '$.brand' AS brand, tags ->> '$.type' AS type FROM cat_assets", "cat_assets"))
def g9(spark, root):
    typed = catalog.typed_json(d.assets(spark, root).select("fqn", "tags"), "tags", "map<string,string>", "{}")
    return typed.select("fqn", F.try_element_at("tags", F.lit("brand")).alias("brand"), F.try_element_at("tags", F.lit("type")).alias("type"))


@query("g10_retention", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS kept FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 10 GROUP BY 1")
def g10(spark, root):
    """Rows inside a ten-day window as of a given day (3650 and 2555 days are the stores' settings)."""
    e = d.events(spark, root).withColumn("day", F.to_date("ts"))
    return catalog.retained(e, "day", d.AS_OF, 10).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("kept"))


@query("g11_page_window", d.with_ctes("SELECT fqn, row_count, (SELECT count(*) FROM cat_assets) AS total, CAST(ceil((SELECT count(*) FROM cat_assets) / 25.0) AS BIGINT) AS total_pages FROM cat_assets ORDER BY row_count DESC, fqn LIMIT 25 OFFSET 50", "cat_assets"))
def g11(spark, root):
    return catalog.page(d.assets(spark, root).select("fqn", "row_count"), [F.col("row_count").desc(), "fqn"], 25, 50)


@query("g12_summary_report", d.with_ctes("""
    , j AS (SELECT a.*, n, p FROM cat_assets a LEFT JOIN (SELECT asset_id, count(*) AS n, count(*) FILTER (WHERE sensitivity_level <> 'PUBLIC') AS p FROM classified GROUP BY 1) c ON c.asset_id = a.asset_id)
    SELECT CAST(row_number() OVER () AS INT) AS position, measure, value FROM (SELECT unnest(['tables', 'rows', 'bytes', 'columns', 'pii_columns', 'grade_A', 'grade_B', 'grade_C', 'grade_D', 'grade_F', 'level_PUBLIC', 'level_INTERNAL', 'level_CONFIDENTIAL', 'level_RESTRICTED']) AS measure,
      unnest([count(*), CAST(sum(row_count) AS BIGINT), CAST(sum(size_bytes) AS BIGINT), CAST(sum(n) AS BIGINT), CAST(sum(p) AS BIGINT), count(*) FILTER (WHERE quality_grade = 'A'), count(*) FILTER (WHERE quality_grade = 'B'), count(*) FILTER (WHERE quality_grade = 'C'),
        count(*) FILTER (WHERE quality_grade = 'D'), count(*) FILTER (WHERE quality_grade = 'F'), count(*) FILTER (WHERE sensitivity_level = 'PUBLIC'), count(*) FILTER (WHERE sensitivity_level = 'INTERNAL'),
        count(*) FILTER (WHERE sensitivity_level = 'CONFIDENTIAL'), count(*) FILTER (WHERE sensitivity_level = 'RESTRICTED')]) AS value FROM j)""".replace("\n    , j AS", "WITH j AS", 1), "classified"))
def g12(spark, root):
    return catalog.summary_report(d.assets(spark, root), classification.pii_counts(_classified(spark, root), ["asset_id"]))


@query("g13_latest_rows", d.with_ctes("SELECT fqn, asset_id, row_count, updated_at FROM (SELECT fqn, asset_id, row_count + l_quantity AS row_count, updated_at + to_minutes(l_orderkey * 8 + l_linenumber) AS updated_at, row_number() OVER (PARTITION BY fqn ORDER BY l_orderkey * 8 + l_linenumber DESC, asset_id DESC, row_count + l_quantity DESC) AS rn FROM lineitem JOIN cat_assets ON asset_key = l_partkey) WHERE rn = 1", "cat_assets"))
def g13(spark, root):
    """Newest version of every asset out of an append-only history."""
    li = d.table(spark, root, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    a = d.assets(spark, root).select("asset_key", "fqn", "asset_id", "row_count", "updated_at")
    minutes = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int")
    history = li.join(a, F.col("l_partkey") == F.col("asset_key")).select(
        "fqn", "asset_id", (F.col("row_count") + F.col("l_quantity")).alias("row_count"), (F.col("updated_at") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("updated_at"))
    return catalog.latest_assets(history)


@query("g14_soft_deletes", d.with_ctes("SELECT source_type, count(*) FILTER (WHERE is_active) AS live, count(*) FILTER (WHERE NOT is_active) AS deleted FROM cat_assets GROUP BY 1", "cat_assets"))
def g14(spark, root):
    return d.assets(spark, root).groupBy("source_type").agg(F.count_if("is_active").alias("live"), F.count_if(~F.col("is_active")).alias("deleted"))
