"""Business glossary: term suggestion, search, assignment, life cycle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.rows import top_k
from ..functions.scalars import col_of, name_tokens, nearest, sim_tokens

NAMES_PER_TASK = 250_000  # different names whose matches one task gathers and ranks


def glossary(spark: SparkSession, terms: Sequence[vocab.Term] = vocab.SEED_TERMS) -> DataFrame:
    """Glossary as a table; ``ordinal`` is insertion order, the tie-breaker of every ranking."""
    rows = [(i, f"term-{i:03d}", t.name, t.definition, t.domain, list(t.synonyms), list(t.abbreviations), "ACTIVE") for i, t in enumerate(terms, 1)]
    return spark.createDataFrame(
        rows,
        "ordinal int, term_id string, name string, definition string, domain string, "
        "synonyms array<string>, abbreviations array<string>, status string",
    )


def token_bag(terms: DataFrame) -> DataFrame:
    """Adds ``bag``: tokens of name and synonyms plus the lower-cased abbreviations."""
    synonym_tokens = F.flatten(F.transform("synonyms", name_tokens))
    abbreviations = F.transform("abbreviations", F.lower)
    return terms.withColumn("bag", F.array_union(F.array_union(name_tokens("name"), synonym_tokens), abbreviations))


def _spread(names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct rows, at most about ``NAMES_PER_TASK`` to a task however few partitions a shuffle has: what follows holds several times their size.

    An estimate of how many there are sets the number of pieces only.
    """
    n = names.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    pieces = -(-n // NAMES_PER_TASK)
    return names.distinct() if pieces < 2 else names.distinct().repartition(pieces, *keys)


def suggest_for_names(names: DataFrame, terms: DataFrame, name_col: str = "column_name", table_col: str | None = None, k: int = 5, floor: float = 0.1) -> DataFrame:
    """Ranked terms per DISTINCT (name, table) pair.

    Only pairs that share a token can score, so names and terms meet in an
    equi-join on the token instead of a product; an exact name or synonym always
    shares its tokens, except when all are shorter than three letters, which
    spelled-out labels in the same join cover. One aggregate gathers both, so the names are
    held once. Work is per distinct name: a hot name is
    counted once however many columns carry it.
    """
    keys = [name_col] + ([table_col] if table_col else [])
    tokens = name_tokens(name_col)
    if table_col:
        tokens = F.array_union(tokens, name_tokens(table_col))
    distinct = _spread(names.select(*keys).filter(F.col(name_col).isNotNull()), keys).withColumn("_tokens", tokens)
    bags = token_bag(terms.filter(F.col("status") == "ACTIVE")).filter(F.size("bag") > 0)

    # one dictionary of tokens and spellings, met once: a spelled row has no bag size
    labels = F.concat(
        F.array(F.struct(F.lower("name").alias("_text"), F.lit(True).alias("_is_name"))),
        F.transform("synonyms", lambda s: F.struct(F.lower(s).alias("_text"), F.lit(False).alias("_is_name"))),
    )
    entry = lambda text, size, is_name: F.struct(text.alias("_text"), size.cast("int").alias("_bag_size"), is_name.cast("boolean").alias("_is_name"))
    words = bags.select("ordinal", F.inline(F.concat(
        F.transform("bag", lambda t: entry(t, F.size("bag"), F.lit(None))), F.transform(labels, lambda x: entry(x["_text"], F.lit(None), x["_is_name"])),
    ))).withColumn("_spelled", F.col("_is_name").isNotNull())
    asked = lambda text, spelled: F.struct(text.alias("_text"), F.lit(spelled).alias("_spelled"))
    met = distinct.select(*keys, F.size("_tokens").alias("_n"), F.inline(F.concat(
        F.transform("_tokens", lambda t: asked(t, False)), F.array(asked(F.lower(name_col), True)),
    ))).join(words, ["_text", "_spelled"])
    # sums and maxima of numbers: hash aggregates without a sort
    both = met.groupBy(*keys, "ordinal").agg(F.count("_bag_size").alias("_common"), F.max("_n").alias("_n"), F.max("_bag_size").alias("_bag_size"), F.max("_is_name").alias("_is_name"))
    jaccard = F.col("_common") / (F.col("_n") + F.col("_bag_size") - F.col("_common"))
    scored = both.withColumn("_jaccard", jaccard).withColumn(
        "score",
        F.when(F.col("_is_name"), 1.0)
        .when(~F.col("_is_name"), F.least(F.coalesce("_jaccard", F.lit(0.0)) + 0.3, F.lit(1.0)))
        .otherwise(F.col("_jaccard")),
    )
    ranked = top_k(scored.filter(F.col("score") > floor), keys, [F.col("score").desc(), F.col("ordinal")], k)
    return ranked.join(terms.select("ordinal", F.col("name").alias("term")), "ordinal").select(
        *keys, "rank", "term", nearest("score", 3).alias("confidence")
    )


def suggest_terms(columns: DataFrame, terms: DataFrame, name_col: str = "column_name", table_col: str | None = None, k: int = 5) -> DataFrame:
    """Suggestions joined back to every column row that carries the name."""
    ranked = suggest_for_names(columns, terms, name_col, table_col, k)
    return columns.join(ranked, [name_col] + ([table_col] if table_col else []))


def sim_glossary(spark: SparkSession, terms=vocab.SIM_TERMS) -> DataFrame:
    rows = [(i, name, list(synonyms)) for i, (name, synonyms) in enumerate(terms, 1)]
    return spark.createDataFrame(rows, "ordinal int, name string, synonyms array<string>")


def suggest_sim(columns: DataFrame, terms: DataFrame, name_col: str = "column_name", k: int = 3, threshold: float = 0.2) -> DataFrame:
    """Offline profile: exact slug, exact synonym, else the first label reaching the threshold; top ``k`` per distinct name.

    Labels and names meet on shared tokens or equal spelling, never in a product.
    """
    names = columns.select(name_col).filter(F.col(name_col).isNotNull()).distinct()
    labels = terms.select(
        "ordinal", "name", F.posexplode(F.concat(F.array("name"), F.col("synonyms"))).alias("_at", "_label")
    ).withColumn("_label_tokens", sim_tokens("_label"))
    spelled = (
        names.withColumn("_key", F.lower(name_col))
        .join(labels.withColumn("_key", F.when(F.col("_at") == 0, F.replace(F.lower("_label"), F.lit(" "), F.lit("_"))).otherwise(F.lower("_label"))), "_key")
        .groupBy(name_col, "ordinal", "name")
        .agg(F.min(F.when(F.col("_at") == 0, 0).otherwise(1)).alias("_kind"))
    )
    fuzzy = (
        names.withColumn("_tokens", sim_tokens(name_col))
        .select(name_col, F.size("_tokens").alias("_n"), F.explode("_tokens").alias("_token"))
        .join(labels.select("ordinal", "name", "_at", F.size("_label_tokens").alias("_m"), F.explode("_label_tokens").alias("_token")), "_token")
        .groupBy(name_col, "ordinal", "name", "_at")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.first("_m").alias("_m"))
        .withColumn("_s", F.col("_c") / (F.col("_n") + F.col("_m") - F.col("_c")))
        .filter(F.col("_s") >= threshold)
        .groupBy(name_col, "ordinal", "name")
        .agg(F.min(F.struct("_at", "_s")).alias("_first"))
        .select(name_col, "ordinal", "name", F.col("_first._s").alias("_s"))
    )
    both = fuzzy.join(spelled, [name_col, "ordinal", "name"], "full_outer").select(
        name_col, "ordinal", F.col("name").alias("term"),
        F.when(F.col("_kind") == 0, 1.0).when(F.col("_kind") == 1, 0.99).otherwise(nearest("_s", 4)).alias("score"),
        F.when(F.col("_kind") == 0, "exact").when(F.col("_kind") == 1, "synonym").otherwise("fuzzy").alias("match_type"),
    )
    return top_k(both, [name_col], [F.col("score").desc(), F.col("ordinal")], k).drop("ordinal")


def search_terms(terms: DataFrame, q: str | None = None, domain: str | None = None, status: str | None = None) -> DataFrame:
    """Terms by domain, status and text in name, definition or any synonym."""
    if domain:
        terms = terms.filter(F.col("domain") == domain)
    if status:
        terms = terms.filter(F.col("status") == status)
    if q:
        needle = q.lower()
        terms = terms.filter(
            F.lower("name").contains(needle) | F.lower("definition").contains(needle)
            | F.exists("synonyms", lambda s: F.lower(s).contains(needle))
        )
    return terms


def split_assignments(assignments: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by existence of the term."""
    known = terms.select("term_id")
    return assignments.join(known, "term_id", "left_semi"), assignments.join(known, "term_id", "left_anti")


def list_assignments(assignments: DataFrame, asset_fqn: str | None = None, term_id: str | None = None) -> DataFrame:
    if asset_fqn:
        assignments = assignments.filter(F.col("asset_fqn") == asset_fqn)
    if term_id:
        assignments = assignments.filter(F.col("term_id") == term_id)
    return assignments


def fold_updates(log: DataFrame, key: str, field_col: str, value_col: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """State after an update log: per key the last value of every field, as partial aggregates."""
    stamp = F.struct(*order)
    aggs = [
        F.max_by(F.when(F.col(field_col) == f, F.col(value_col)), F.when(F.col(field_col) == f, stamp)).alias(f) for f in fields
    ]
    return log.groupBy(key).agg(*aggs, F.max(order[0]).alias("updated_at"), F.count(F.lit(1)).alias("update_count"))


# Fields of a term that an update may change, and the states it can be in.
UPDATABLE_FIELDS = ("name", "definition", "domain", "status")
TERM_STATUS = ("DRAFT", "ACTIVE", "DEPRECATED")


def apply_updates(terms: DataFrame, log: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Terms after an update log (term_id, field, value, and the ``order`` columns): the last allowed value of every field wins.

    Other fields and unknown states are ignored; a term that is deprecated stays listed. Adds updated_at and update_count.
    """
    allowed = log.filter(F.col("field").isin(*UPDATABLE_FIELDS) & ((F.col("field") != "status") | F.col("value").isin(*TERM_STATUS)))
    state = fold_updates(allowed, "term_id", "field", "value", order, UPDATABLE_FIELDS)
    ours = state.select("term_id", *[F.col(f).alias(f"_{f}") for f in UPDATABLE_FIELDS], "updated_at", "update_count")
    met = terms.join(ours, "term_id", "left")
    return met.withColumns({f: F.coalesce(f"_{f}", f) for f in UPDATABLE_FIELDS} | {"update_count": F.coalesce("update_count", F.lit(0))}).select(*terms.columns, "updated_at", "update_count")


def deprecate(terms: DataFrame, retired: DataFrame) -> DataFrame:
    """Status DEPRECATED for the listed term ids; nothing is deleted."""
    flags = retired.select("term_id").distinct().withColumn("_gone", F.lit(True))
    return terms.join(flags, "term_id", "left").withColumn("status", F.when(F.col("_gone"), "DEPRECATED").otherwise(F.col("status"))).drop("_gone")


def table_terms(table_name: Column, k: int = 5) -> Column:
    """Up to ``k`` distinct terms implied by the words of a table name, in dictionary order."""
    words = F.split(F.lower(table_name), "_")
    hits = [F.when(F.array_contains(words, word), F.array(*[F.lit(t) for t in terms])).otherwise(F.array().cast("array<string>")) for word, terms in vocab.TABLE_TERMS.items()]
    return F.slice(F.array_distinct(F.concat(*hits)), 1, k)


def _words(text: str) -> list[str]:
    """``name_tokens`` of a constant."""
    return list(dict.fromkeys(w.lower() for w in re.split(r"[_\-\s]+", re.sub(r"([A-Z][a-z])", r" \1", text)) if len(w) > 2))


def _strings(values: Sequence[str]) -> str:
    return "cast(array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ") as array<string>)"


def _numbers(values: Sequence[int]) -> str:
    return "cast(array(" + ", ".join(map(str, values)) + ") as array<int>)"


def _ordinals_of(spellings: dict[str, list[int]]) -> Column:
    """A literal map from a spelling to the places of the terms that have it."""
    entries = [f"{_strings([word])}[0], {_numbers(places)}" for word, places in spellings.items()]
    return F.expr(f"map({', '.join(entries)})" if entries else "cast(map() as map<string, array<int>>)")


def column_terms(name_col: Column | str, terms: Sequence[vocab.Term] = vocab.SEED_TERMS, k: int = 5, floor: float = 0.1) -> Column:
    """Names of the best ``k`` terms of a column name, best first: one projection over a glossary of fixed size, so it also runs in a stream.

    The name is cut into tokens once, its tokens and spelling are looked up, and only the terms found there are scored; no other term has a score.
    """
    name = col_of(name_col)
    of_token: dict[str, list[int]] = {}
    of_spelling: dict[str, list[int]] = {}
    entries = []
    for i, t in enumerate(terms):
        bag = list(dict.fromkeys([*_words(t.name), *[w for x in t.synonyms for w in _words(x)], *[x.lower() for x in t.abbreviations]]))
        for word in bag:
            of_token.setdefault(word, []).append(i)
        for word in dict.fromkeys([t.name.lower(), *[x.lower() for x in t.synonyms]]):
            of_spelling.setdefault(word, []).append(i)
        entries.append(f"named_struct('term', {_strings([t.name])}[0], 'bag', {len(bag)}, 'name', {_strings([t.name.lower()])}[0])")
    if not entries:
        return F.array().cast("array<string>")
    known, by_token, by_spelling = F.expr(f"array({', '.join(entries)})"), _ordinals_of(of_token), _ordinals_of(of_spelling)
    none = F.array().cast("array<int>")
    every = F.expr(_numbers(range(len(entries))))

    def ranked(facts: Column) -> Column:
        places = F.array_distinct(F.concat(facts["hits"], facts["spelled"])) if floor >= 0 else every

        def scored(place: Column) -> Column:
            t = F.get(known, place)
            common = F.size(F.filter(facts["hits"], lambda hit: hit == place))
            both = facts["tokens"] + t["bag"] - common
            score = F.when(both > 0, common / both).otherwise(0.0)
            boosted = F.when(facts["lower"] == t["name"], 1.0).when(F.array_contains(facts["spelled"], place), F.least(score + 0.3, F.lit(1.0))).otherwise(score)
            return F.struct((-boosted).alias("score"), place.alias("ordinal"), t["term"].alias("term"))

        found = F.filter(F.transform(places, scored), lambda x: -x["score"] > floor)
        return F.transform(F.slice(F.array_sort(found), 1, k), lambda x: x["term"])

    def looked_up(tokens: Column) -> Column:
        hits = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(by_token, t), none)))
        lower = F.lower(name)
        return F.struct(F.size(tokens).alias("tokens"), hits.alias("hits"), lower.alias("lower"), F.coalesce(F.try_element_at(by_spelling, lower), none).alias("spelled"))

    # one-element arrays: what a lambda is given is worked out once, not at each use
    best = F.get(F.transform(F.transform(F.array(name_tokens(name)), looked_up), ranked), F.lit(0))
    return F.when(name.isNull(), F.array().cast("array<string>")).otherwise(best)


def asset_terms(ranked_columns: DataFrame, keys: Sequence[str], term_col: str = "term") -> DataFrame:
    """Sorted distinct top terms per asset; the set is bounded by the glossary, not by the data."""
    top = ranked_columns.filter(F.col("rank") == 1)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_set(term_col)).alias("business_terms"))


def term_usage(assets: DataFrame, terms_col: str = "suggested_terms") -> DataFrame:
    return assets.select(F.explode(terms_col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("asset_count"))


