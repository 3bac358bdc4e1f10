"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_array(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values: Sequence, position: Column) -> Column:
    """values[position], position counted from 0, NULL for a NULL position.

    element_at over a literal array is typed non-nullable in ANSI mode and then misreads a
    NULL index, so the try_ form is used.
    """
    return F.try_element_at(literal_array(values), position.cast("int") + 1)


def highest(columns: Sequence[Column]) -> Column:
    """greatest() that also takes a single column."""
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def nearest(value: Column | str, digits: int) -> Column:
    """Decimal of ``digits`` places nearest to the stored binary number, ties to even.

    Spark's round works on the printed decimal: 0.41395 is stored slightly below the tie
    and still goes up. Scores follow the stored number. The value is split into a float and
    a remainder, so that the distance to the tie is computed without rounding error; good
    for magnitudes up to about 10^4.
    """
    x, scale = col_of(value), float(10**digits)
    head = x.cast("float").cast("double")
    whole = F.floor(x * scale).cast("double")
    past_tie = (head * scale - whole - 0.5) + (x - head) * scale
    step = F.when(past_tie > 0, 1.0).when(past_tie < 0, 0.0).otherwise(F.pmod(whole, F.lit(2.0)))
    return (whole + step) / scale


# ---- ordered scales -------------------------------------------------------
def sensitivity_rank(level: Column | str) -> Column:
    return F.array_position(literal_array(vocab.SENSITIVITY), col_of(level)).cast("int") - 1


def sensitivity_name(rank: Column) -> Column:
    return pick(vocab.SENSITIVITY, rank)


def role_rank(role: Column | str) -> Column:
    """-1 for unknown or missing roles."""
    return F.coalesce(F.array_position(literal_array(vocab.ROLES), col_of(role)).cast("int"), F.lit(0)) - 1


def grade_of(score: Column | str) -> Column:
    score = col_of(score)
    expr = None
    for grade, floor in vocab.GRADES[:-1]:
        expr = F.when(score >= floor, grade) if expr is None else expr.when(score >= floor, grade)
    return expr.otherwise(vocab.GRADES[-1][0])


# ---- checksums, masks -----------------------------------------------------
def luhn_ok(text: Column | str) -> Column:
    """Luhn checksum over the digits of ``text``; at least 13 digits are required."""
    digits = F.regexp_replace(col_of(text), "[^0-9]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def mask_email(email: Column | str) -> Column:
    return F.regexp_replace(col_of(email), r"(.{2}).+(@.+)", "$1***$2")


# ---- tokens ---------------------------------------------------------------
def name_tokens(text: Column | str) -> Column:
    """Lower-cased words longer than two letters from snake_case, kebab-case and CamelCase."""
    spaced = F.regexp_replace(col_of(text), r"([A-Z][a-z])", " $1")
    words = F.filter(F.split(spaced, r"[_\-\s]+"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(words, F.lower))


def sim_tokens(text: Column | str) -> Column:
    """Offline-profile tokenizer: every capital starts a word, words of one letter are dropped."""
    spaced = F.lower(F.regexp_replace(col_of(text), r"([A-Z])", "_$1"))
    return F.array_distinct(F.filter(F.split(spaced, r"[_\s\-]+"), lambda w: F.length(w) > 1))


def jaccard(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))


def title_case(text: Column | str) -> Column:
    """Capital after every non-letter, which initcap alone does not do."""
    runs = F.regexp_extract_all(col_of(text), F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def readable(name: Column | str) -> Column:
    return title_case(F.regexp_replace(col_of(name), r"[_\-]", " "))


# ---- names and ids --------------------------------------------------------
def asset_fqn(source_type: Column | str, schema: Column | str, table: Column | str) -> Column:
    return F.concat_ws(".", col_of(source_type), col_of(schema), col_of(table))


def uri_fqn(platform: Column | str, schema: Column | str, table: Column | str) -> Column:
    return F.concat(col_of(platform), F.lit("://"), col_of(schema), F.lit("."), col_of(table))


def host_fqn(platform: Column | str, host: Column | str, schema: Column | str, table: Column | str) -> Column:
    return F.concat(col_of(platform), F.lit("://"), F.concat_ws("/", col_of(host), col_of(schema), col_of(table)))


def database_fqn(platform, database, schema, table) -> Column:
    return F.concat_ws(".", *[col_of(c) for c in (platform, database, schema, table)])


def fqn_label(fqn: Column | str) -> Column:
    return F.substring_index(col_of(fqn), ".", -1)


def fqn_schema(fqn: Column | str) -> Column:
    fqn = col_of(fqn)
    cut = F.length(fqn) - F.length(fqn_label(fqn)) - 1
    return F.when(cut > 0, F.substr(fqn, F.lit(1), cut)).otherwise("")


def asset_id(fqn: Column | str) -> Column:
    """Deterministic id, so that a re-run or a stream retry writes the same row."""
    return F.concat(F.lit("asset-"), F.substring(F.md5(col_of(fqn).cast("binary")), 1, 12))


def dataset_urn(platform: Column | str, name: Column | str, env: str = "PROD") -> Column:
    return F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), col_of(platform), F.lit(","), col_of(name), F.lit(f",{env})"))


def datajob_urn(flow: Column | str, job: Column | str) -> Column:
    return F.concat(F.lit("urn:li:dataJob:(urn:li:dataFlow:(orchestrator,"), col_of(flow), F.lit(",PROD),"), col_of(job), F.lit(")"))


# ---- presentation ---------------------------------------------------------
def human_bytes(size: Column | str) -> Column:
    size = col_of(size).cast("double")
    units = ("B", "KB", "MB", "GB", "TB")
    expr = None
    for power, unit in enumerate(units):
        text = F.concat(F.format_string("%.1f", F.bround(size / float(1024**power), 1)), F.lit(f" {unit}"))
        test = size < float(1024 ** (power + 1))
        expr = F.when(test, text) if expr is None else expr.when(test, text)
    return expr.otherwise(F.concat(F.format_string("%.1f", F.bround(size / float(1024**5), 1)), F.lit(" PB")))


def human_rows(rows: Column | str) -> Column:
    rows = col_of(rows)
    return (
        F.when(rows >= 1_000_000, F.concat(F.format_string("%.2f", F.bround(rows / 1_000_000.0, 2)), F.lit("M")))
        .when(rows >= 1_000, F.concat(F.format_string("%.1f", F.bround(rows / 1_000.0, 1)), F.lit("K")))
        .otherwise(rows.cast("string"))
    )


# ---- time -----------------------------------------------------------------
def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, read as UTC."""
    return F.unix_seconds(col_of(ts).cast("timestamp"))


def bucket_start(ts: Column | str, seconds: int) -> Column:
    """Start (epoch seconds) of the tumbling bucket ``ts`` falls into."""
    epoch = epoch_seconds(ts)
    return epoch - F.pmod(epoch, F.lit(seconds))


def exact_sum(value: Column | str, scale: int = 2) -> Column:
    """Sum of doubles that carry ``scale`` decimals, independent of the order of rows."""
    return F.sum(col_of(value).cast(f"decimal(28,{scale})")).cast("double")
