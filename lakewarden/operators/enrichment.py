"""Enrichment: domains, descriptions, ids, and the assembled asset document."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.rows import split_parts, top_k
from ..functions.scalars import asset_fqn, asset_id, col_of, pick, readable

# Characters a name may have before positions of two columns would overlap in one number.
_NAME_SPAN = 1 << 24


def winner(scores: dict[str, Column]) -> Column:
    """Name with the highest positive score, ties to the earlier one, NULL when all are zero."""
    size = len(scores)
    packed = [
        F.when(score > 0, score.cast("int") * size + (size - 1 - i)) for i, score in enumerate(scores.values())
    ]
    best = F.lit(size - 1) - F.pmod(F.greatest(*packed), F.lit(size))
    return pick(tuple(scores), best)


def infer_domains(columns: DataFrame, keys: Sequence[str], table_col: str, name_col: str, ordinal_col: str, patterns: dict = vocab.DOMAIN_PATTERNS) -> DataFrame:
    """Domain per table from table name and column names.

    The semantics are those of one text: the table name followed by all column names.
    That text is never built. A plain pattern is found in it when some name holds it; a
    gap pattern 'a.*b' is found when the first 'a' ends before the last 'b' starts. Both are worked out once per
    different name (a bit per pattern, two positions per gap) and joined to the columns; per table remain
    an OR of bits and minima and maxima of packed positions: partial aggregates
    only, so a table with a third of all columns costs no more memory than any other.
    """
    plain, gaps = [], []
    for regexes in patterns.values():
        for regex in regexes:
            parts = regex.split(".*")
            if len(parts) > 2 or any(re.search(r"[^\w ]", part) for part in parts):
                raise ValueError(f"not a word, nor two with a gap: {regex}")
            (gaps if len(parts) == 2 else plain).append(regex)

    def facts(text: Column) -> list[Column]:
        bits = F.lit(0).cast("bigint")
        for i, word in enumerate(plain):
            bits = bits + F.when(text.contains(word), F.lit(1 << i)).otherwise(F.lit(0))
        out = [bits.alias("bits")]
        for i, regex in enumerate(gaps):
            head, tail = regex.split(".*")
            first, last = F.instr(text, head), F.instr(F.reverse(text), tail[::-1])
            out += [F.when(first > 0, first + len(head)).alias(f"a{i}"), F.when(last > 0, F.length(text) - last - len(tail) + 2).alias(f"b{i}")]
        return out

    names = columns.select(F.col(name_col).alias("_name")).distinct().select("_name", F.struct(*facts(F.lower("_name"))).alias("_f"))
    rows = columns.select(*keys, F.col(table_col).alias("_table"), F.col(name_col).alias("_own"), (F.col(ordinal_col) * _NAME_SPAN).alias("_at"))
    met = rows.join(names, F.col("_own").eqNullSafe(F.col("_name")))
    aggs = [F.bit_or("_f.bits").alias("_bits"), F.min("_table").alias("_table")]
    for i in range(len(gaps)):
        aggs += [F.min(F.col(f"_f.a{i}") + F.col("_at")).alias(f"_a{i}"), F.max(F.col(f"_f.b{i}") + F.col("_at")).alias(f"_b{i}")]
    grouped = met.groupBy(*keys).agg(*aggs).withColumn("_t", F.struct(*facts(F.lower("_table"))))
    bits = F.coalesce("_bits", F.lit(0)).bitwiseOR(F.coalesce("_t.bits", F.lit(0)))
    scores = {}
    for domain, regexes in patterns.items():
        score = F.lit(0)
        for regex in regexes:
            if regex in plain:
                hit = F.getbit(bits, F.lit(plain.index(regex))) == 1
            else:
                i = gaps.index(regex)
                # the table name stands before every column
                hit = (F.col(f"_t.a{i}") <= F.col(f"_t.b{i}")) | (F.col(f"_t.a{i}").isNotNull() & F.col(f"_b{i}").isNotNull()) | (F.col(f"_a{i}") <= F.col(f"_b{i}"))
            score = score + F.coalesce(hit, F.lit(False)).cast("int")
        scores[domain] = score
    return grouped.select(*keys, winner(scores).alias("domain"))


def sim_domain(schema: Column | str, table: Column | str, words: dict = vocab.SIM_DOMAIN_WORDS) -> Column:
    """Offline profile: number of keywords in schema and table name; 'general' when none occurs."""
    text = F.lower(F.concat_ws(" ", col_of(schema), col_of(table)))
    scores = {}
    for domain, keywords in words.items():
        score = F.lit(0)
        for word in keywords:
            score = score + text.contains(word).cast("int")
        scores[domain] = score
    return F.coalesce(winner(scores), F.lit("general"))


def column_description(description: Column | str, name: Column | str, data_type: Column | str) -> Column:
    """Keeps a real description; replaces missing and placeholder ones by a template."""
    text = col_of(description)
    blank = text.isNull() | F.trim(F.lower(text)).isin(*vocab.BLANK_DESCRIPTIONS)
    made = F.concat(F.lit("The "), readable(name), F.lit(" field ("), col_of(data_type), F.lit("). Auto-generated — please review."))
    return F.when(blank, made).otherwise(text)


def table_descriptions(columns: DataFrame, keys: Sequence[str], schema_col: str, table_col: str, name_col: str, order: Sequence[str]) -> DataFrame:
    """Template naming the first five columns; only five rows per table reach the aggregate."""
    head = top_k(columns, keys, [F.col(c) for c in order], 5)
    names = F.transform(F.sort_array(F.collect_list(F.struct("rank", name_col))), lambda s: s[name_col])
    grouped = head.groupBy(*keys).agg(F.first(schema_col).alias("_s"), F.first(table_col).alias("_t"), F.array_join(names, ", ").alias("_n"))
    text = F.concat(
        readable("_t"), F.lit(" contains records from the "), F.col("_s"), F.lit(" schema. Key columns include: "), F.col("_n"),
        F.lit(". Auto-generated — please enrich via the Data Catalog UI."),
    )
    return grouped.select(*keys, text.alias("description"))


def column_documents(columns: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], limit: int = 2000) -> DataFrame:
    """Columns of an asset as arrays of structs, in bounded parts ordered by ``order`` within the part."""
    split = split_parts(columns, keys, order, limit)
    return split.groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct(order, *fields))).alias("columns"), F.count(F.lit(1)).alias("column_count")
    )


def identify(df: DataFrame, source: str = "source_type", schema: str = "schema_name", table: str = "table_name") -> DataFrame:
    """Adds the canonical name and the id derived from it."""
    return df.withColumn("fqn", asset_fqn(source, schema, table)).withColumn("asset_id", asset_id("fqn"))
