"""Personal and sensitive data: name rules, value confirmation, roll-ups, whole-lake value scan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import col_of, highest, literal_array, luhn_ok, pick, role_rank, sensitivity_name, sensitivity_rank


def _best_rule(rules: Sequence[vocab.Rule], hits: Sequence[Column]) -> Column:
    """Index of the winning rule: highest level, then earliest. NULL when none fires.

    The rules are literals of one projection, so matching
    needs neither a join nor a shuffle however many columns there are.
    """
    size = len(rules)
    codes = [
        F.when(hit, F.lit(vocab.SENSITIVITY.index(rule.level) * size + (size - 1 - i)))
        for i, (rule, hit) in enumerate(zip(rules, hits))
    ]
    return F.lit(size - 1) - F.pmod(highest(codes), F.lit(size))


def _words_of(pattern: str) -> list[str] | None:
    """Spellings accepted by a pattern of the form (^|_)(a|b|c?d)($|_), None for any other pattern."""
    shape = re.fullmatch(r"\(\^\|_\)\(([a-z0-9_|?]+)\)\(\$\|_\)", pattern)
    if not shape:
        return None
    words = []
    for word in shape.group(1).split("|"):
        optional = re.fullmatch(r"(\w*)(\w)\?(\w*)", word)
        if optional:
            words += [optional[1] + optional[3], optional[1] + optional[2] + optional[3]]
        elif "?" in word:
            return None
        else:
            words.append(word)
    return words


def _name_hit(name: Column, padded: Column, pattern: str) -> Column:
    """Whole-word patterns are substring tests on the name between underscores, several times cheaper than a regex."""
    words = _words_of(pattern)
    if words is None:
        return name.rlike(pattern)
    test = padded.contains(f"_{words[0]}_")
    for word in words[1:]:
        test = test | padded.contains(f"_{word}_")
    return test


def _any_sample(samples: Column, test) -> Column:
    return F.exists(samples, lambda v: (v != "") & test(v))


def _matches(pattern: str):
    return lambda v: v.rlike(pattern)


def classify(
    df: DataFrame,
    name_col: str = "column_name",
    samples_col: str = "sample_values",
    rules: Sequence[vocab.Rule] = vocab.SERVICE_RULES,
) -> DataFrame:
    """Adds classification, category and sensitivity_level.

    A rule fires when its name pattern is found in the lower-cased name and, where
    it has a value pattern and samples exist, one sample matches; cards also need a
    valid checksum. Names no rule knows fall back to a short word list.
    """
    name = F.lower(F.col(name_col))
    padded = F.concat(F.lit("_"), name, F.lit("_"))
    samples = F.coalesce(F.col(samples_col), F.array().cast("array<string>"))
    empty = F.size(samples) == 0
    hits = []
    for rule in rules:
        hit = _name_hit(name, padded, rule.name_re)
        if rule.value_re:
            hit = hit & (empty | _any_sample(samples, _matches(rule.value_re)))
        if rule.category == "CREDIT_CARD":
            hit = hit & (empty | _any_sample(samples, luhn_ok))
        hits.append(hit)
    fallback = name.rlike("|".join(vocab.FALLBACK_WORDS))
    with_rule = df.withColumn("_rule", _best_rule(rules, hits))
    found = F.col("_rule").isNotNull()
    level = F.when(found, pick([r.level for r in rules], F.col("_rule"))).when(fallback, "INTERNAL").otherwise("PUBLIC")
    return (
        with_rule.withColumn("category", F.when(found, pick([r.category for r in rules], F.col("_rule"))))
        .withColumn("sensitivity_level", level)
        .withColumn(
            "classification",
            F.when(found & F.col("sensitivity_level").isin("CONFIDENTIAL", "RESTRICTED"), "PII").when(found | fallback, "SENSITIVE"),
        )
        .drop("_rule")
    )


def classify_distinct(df: DataFrame, name_col: str = "column_name", samples_col: str = "sample_values", rules: Sequence[vocab.Rule] = vocab.SERVICE_RULES) -> DataFrame:
    """``classify`` with its rules run once per different (name, samples), which map-side combine finds; rows meet the result by an equi-join."""
    pairs = df.select(F.col(name_col).alias("_name"), F.col(samples_col).alias("_samples")).distinct()
    found = classify(pairs, "_name", "_samples", rules)
    return df.join(found, F.col(name_col).eqNullSafe(F.col("_name")) & F.col(samples_col).eqNullSafe(F.col("_samples"))).drop("_name", "_samples")


def classify_sim(df: DataFrame, name_col: str = "column_name", samples_col: str = "sample_values", rules: Sequence[vocab.Rule] = vocab.SIM_RULES) -> DataFrame:
    """Offline profile: name and any value found case-insensitively; no samples count as a match.

    There the card checksum never overrules a matching name, so it takes no part.
    """
    name = F.col(name_col)
    samples = F.coalesce(F.col(samples_col), F.array().cast("array<string>"))
    empty = F.size(samples) == 0
    hits = []
    for rule in rules:
        name_hit = name.rlike(f"(?i){rule.name_re}")
        value_hit = F.exists(samples, _matches(f"(?i){rule.value_re}"))
        hits.append(name_hit & (empty | value_hit))
    with_rule = df.withColumn("_rule", _best_rule(rules, hits))
    found = F.col("_rule").isNotNull()
    return (
        with_rule.withColumn("category", F.when(found, pick([r.category for r in rules], F.col("_rule"))).otherwise("NONE"))
        .withColumn("sensitivity_level", F.when(found, pick([r.level for r in rules], F.col("_rule"))).otherwise("PUBLIC"))
        .drop("_rule")
    )


def classify_heuristic(df: DataFrame, name_col: str = "column_name") -> DataFrame:
    """Name-only heuristic: the first pattern wins, then a list of sensitive words."""
    name = F.lower(F.col(name_col))
    category = None
    for pattern, label in vocab.HEURISTIC_PII:
        test = name.rlike(pattern)
        category = F.when(test, label) if category is None else category.when(test, label)
    words = name.rlike("|".join(vocab.HEURISTIC_SENSITIVE))
    return df.withColumn("category", category).withColumn(
        "classification", F.when(F.col("category").isNotNull(), "PII").when(words, "SENSITIVE")
    )


def table_sensitivity(columns: DataFrame, keys: list[str], mode: str = "service") -> DataFrame:
    """Level of a table: service promotes PII to RESTRICTED and SENSITIVE to CONFIDENTIAL; max takes the highest column."""
    if mode == "service":
        rank = F.when(F.col("classification") == "PII", 3).when(F.col("classification") == "SENSITIVE", 2).otherwise(0)
    elif mode == "max":
        rank = sensitivity_rank("sensitivity_level")
    else:
        raise ValueError(f"unknown mode: {mode}")
    return columns.groupBy(*keys).agg(F.max(rank).alias("_r")).select(*keys, sensitivity_name(F.col("_r")).alias("sensitivity_level"))


def pii_assets(assets: DataFrame, columns: DataFrame) -> DataFrame:
    """Sensitive columns of active assets with owner and steward. Filters run below the join."""
    a = assets.filter("is_active").select(
        "asset_id", F.col("fqn").alias("asset_fqn"), "schema_name", "table_name", "source_type",
        F.col("sensitivity_level").alias("table_sensitivity"), "data_owner", "data_steward",
    )
    c = columns.filter(F.col("classification").isin("PII", "SENSITIVE")).select(
        "asset_id", "column_name", "classification", "category", F.col("sensitivity_level").alias("column_sensitivity")
    )
    return a.join(c, "asset_id").drop("asset_id")


def pii_counts(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Non-public columns per asset."""
    return columns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(F.col("sensitivity_level") != "PUBLIC").alias("pii_column_count"),
        F.count_if(F.col("sensitivity_level") == "RESTRICTED").alias("restricted_count"),
    )


def restricted_columns(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Alert list, one row per restricted column: rows rather than one growing list per asset."""
    return columns.filter(F.col("sensitivity_level") == "RESTRICTED").groupBy(*keys, "column_name").agg(F.count(F.lit(1)).alias("occurrences"))


def dashboard(columns: DataFrame, level: str | None = None, classification: str | None = None) -> DataFrame:
    """Totals of the classification page, optionally for one level or class."""
    if level:
        columns = columns.filter(F.col("sensitivity_level") == level)
    if classification:
        columns = columns.filter(F.col("classification") == classification)
    return columns.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sensitivity_level") == "RESTRICTED").alias("restricted"),
        F.count_if(F.col("sensitivity_level") == "CONFIDENTIAL").alias("confidential"),
        F.count_if(F.col("classification") == "PII").alias("pii"),
    )


def rule_inventory(spark, rules: Sequence[vocab.Rule] = vocab.SERVICE_RULES) -> DataFrame:
    rows = spark.createDataFrame([(r.category, r.level) for r in rules], "category string, level string")
    return rows.agg(
        F.count(F.lit(1)).alias("total_rules"), F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("level")).alias("levels"),
    )


def default_level(category: Column | str) -> Column:
    pairs = [F.lit(x) for kv in vocab.CATEGORY_LEVEL.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col_of(category))


def _may_match(value: Column, category: str) -> Column | None:
    """What every match of a category's pattern holds: a cheap look that spares most values the pattern itself."""
    if category == "EMAIL":
        return value.contains("@")
    if category == "IP_ADDRESS":
        return value.contains(".") & value.rlike("[0-9]")
    return None if category == "PHONE" else value.rlike("[0-9]{2}")


def value_scan(df: DataFrame, table: str, columns: Sequence[str], patterns: Sequence[tuple[str, str]] = vocab.VALUE_SCAN) -> DataFrame:
    """Every value of the given text columns against every pattern, whole texts, one pass.

    Per row and column the matches of one pattern are counted inside the
    projection, after a cheap look for what they must hold; only sums per (column, category) are shuffled.
    """
    known = {category for category, _ in vocab.VALUE_SCAN} if patterns is vocab.VALUE_SCAN else set()
    found, aggs, entries = [], [F.count(F.lit(1)).alias("_rows")], []
    for c in columns:
        for i, (category, pattern) in enumerate(patterns):
            key = f"{c}_{i}"
            matched = F.regexp_extract_all(F.col(c), F.lit(f"({pattern})"), 1)
            gate = _may_match(F.col(c), category) if category in known else None
            found.append((matched if gate is None else F.when(gate, matched).when(F.col(c).isNotNull(), F.array().cast("array<string>"))).alias(key))
            matches = F.col(key)
            aggs += [
                F.coalesce(F.sum(F.size(matches)), F.lit(0)).alias(f"hits_{key}"),
                F.count_if(F.size(matches) > 0).alias(f"rows_{key}"),
            ]
            valid = F.lit(None).cast("bigint")
            if category == "CREDIT_CARD":
                aggs.append(F.coalesce(F.sum(F.size(F.filter(matches, luhn_ok))), F.lit(0)).alias(f"valid_{key}"))
                valid = F.col(f"valid_{key}").cast("bigint")
            entries.append(F.struct(
                F.lit(c).alias("column_name"), F.lit(category).alias("category"),
                F.col(f"hits_{key}").cast("bigint").alias("hits"), F.col(f"rows_{key}").alias("rows_with_hit"),
                valid.alias("checksum_valid"),
            ))
    return (
        df.select(*found).agg(*aggs)
        .select(F.lit(table).alias("table_name"), "_rows", F.inline(F.array(*entries)))
        .withColumn("match_rate", F.when(F.col("_rows") > 0, F.round(F.col("rows_with_hit") / F.col("_rows"), 6)))
        .drop("_rows")
    )


def mask_for_role(df: DataFrame, role: str) -> DataFrame:
    """What a role sees: classification only for stewards and admins, samples masked by level above the role."""
    may_see = role_rank(F.lit(role)) >= vocab.ROLES.index("data_steward")
    hidden = sensitivity_rank("sensitivity_level") >= F.lit(2)
    masked = F.transform("sample_values", lambda v: F.when(v.contains("@"), F.regexp_replace(v, r"(.{2}).+(@.+)", "$1***$2")).otherwise(F.mask(v)))
    return df.withColumns({
        "shown_classification": F.when(F.col("classification").isNull() | may_see, F.col("classification")).otherwise("Restricted"),
        "shown_category": F.when(may_see, F.col("category")),
        "shown_samples": F.when(may_see | ~hidden, F.col("sample_values")).otherwise(masked),
    })


def known_categories() -> Column:
    return literal_array(vocab.CATEGORIES)
