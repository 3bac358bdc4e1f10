"""Personal data by regular expressions, checksums and context, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges
for addresses, digit counts for phones), and words near a span raise its score. The four base kinds
are always kept once valid; kinds that the method adds (iban, ssn) only with a score of
``MIN_SCORE``. One projection per row: no shuffle, no Python.

Positions are code points, the end exclusive. The pieces between matches and the matches
themselves are both read from the text, so positions are running sums of their lengths. Quantifiers are
possessive and a match may only begin where its run begins or where the last match ended, which
changes no result and keeps long runs linear; so do texts of many spans, whose places are gathered in blocks and whose
surroundings are read from pieces of bounded length. A null text is empty; an empty text has no spans; repeated rows and null ids
give rows like any other, an empty table none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, text_of

LOCAL = "A-Za-z0-9._%+-"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: length -> countries whose IBANs have it
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Where an IBAN may begin, and all of it: as long as its country says, others as far as they go.
IBAN_START = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2} ?[A-Z0-9])"
IBAN = "^(?:" + "|".join(
    [rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()]
    + [rf"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}"]
) + ")(?![A-Za-z0-9])"
IBAN_CHARS = 70
#: characters of a piece of text (at least those read at once), and spans of a block
CHUNK, BLOCK = 128, 128
#: kind -> (pattern, characters without which no match is possible)
PATTERNS = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[ -]?+[0-9])++", ""),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    "iban": (IBAN_START, ""),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
}
#: kind -> score of a valid span, before context
CONFIDENCE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|mail|contact|write", "ip": "ip|address|host|server|login", "card": "card|visa|mastercard|credit|payment|cvv",
    "phone": "phone|tel|call|mobile|fax|cell", "iban": "iban|bank|account|transfer|bic", "ssn": "ssn|social|security|tax",
}
CONTEXT_CHARS, CONTEXT_SCORE, MIN_SCORE = 48, 0.2, 0.5
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _gathered(items: Column, step: Callable[[Column, Column], tuple[Column, Column, Column, Column]]) -> Column:
    """array<struct<start, end>> from left to right: ``step(at, item)`` gives the next ``at``, a start, an end and whether to keep them.

    A fold copies all it holds in each step, so items are taken in blocks of ``BLOCK``: first ``at`` at the beginning of
    every block, then the spans of each block for itself.
    """
    zero = F.lit(0).cast("bigint")

    def add(acc: Column, item: Column) -> Column:
        at, start, end, keep = step(acc["at"], item)
        span = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct(at.cast("bigint").alias("at"), F.when(keep, F.concat(acc["some"], span)).otherwise(acc["some"]).alias("some"))

    def begins(acc: Column, block: Column) -> Column:
        after = F.aggregate(block, acc["at"], lambda at, item: step(at, item)[0].cast("bigint"))
        return F.struct(after.alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before"))

    def spans(pair: Column) -> Column:
        none = F.array().cast("array<struct<start:bigint,end:bigint>>")
        return F.aggregate(pair["block"], F.struct(pair["at"].alias("at"), none.alias("some")), add, lambda acc: acc["some"])

    def gathered(blocks: Column) -> Column:
        ats = F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("before")), begins, lambda acc: acc["before"])
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), ats.alias("at")), spans))

    def cut(whole: Column) -> Column:
        last = F.greatest(F.floor((F.size(whole) - 1) / BLOCK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)))

    return _let(_let(items, cut), gathered)


def _chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` characters: reading near a place does not count characters from the beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _read(chunks: Column, start: Column, chars: Column) -> Column:
    """``chars`` characters, ``CHUNK`` at most, from ``start`` on."""
    at = F.floor(start / CHUNK).cast("int")
    both = F.concat(F.coalesce(F.get(chunks, at), F.lit("")), F.coalesce(F.get(chunks, at + 1), F.lit("")))
    return F.substring(both, (start % CHUNK + 1).cast("int"), chars.cast("int"))


def _places(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """array<struct<start, end>> of the valid ones among all matches, leftmost first, none overlapping."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(found.alias("value"), between.alias("gap")), lambda p: p["value"].isNotNull())
    marks = F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["value"]).alias("size"), valid(p["value"]).alias("valid")))
    return _gathered(marks, lambda at, m: (at + m["gap"] + m["size"], at + m["gap"], at + m["gap"] + m["size"], m["valid"]))


def _ibans(text: Column, valid: Callable[[Column], Column]) -> Column:
    """The valid IBANs like ``_places``: every place where one may begin is tried, so a span that fails hides none after it."""
    starts = _gathered(F.transform(F.split(text, IBAN_START, -1), F.length), lambda at, n: (at + n, at, at + n, F.lit(True)))

    def tried(chunks: Column) -> Column:
        values = F.transform(starts, lambda s: F.struct(s["start"].alias("start"), F.regexp_extract(_read(chunks, s["start"], F.lit(IBAN_CHARS)), IBAN, 0).alias("value")))
        return F.filter(values, lambda s: valid(s["value"]))

    def apart(end: Column, s: Column) -> tuple[Column, Column, Column, Column]:  # the leftmost of those that overlap
        stop, free = s["start"] + F.length(s["value"]), end <= s["start"]
        return F.when(free, stop).otherwise(end), s["start"], stop, free

    return _gathered(_let(_chunks(text), tried), apart)


def luhn(digits: Column) -> Column:
    """The Luhn check over a string of digits."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """The IBAN check over letters and digits without blanks: the first four moved to the end leave 1."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def add(acc: Column, i: Column) -> Column:
        value = F.instr(F.lit(letters), F.substring(moved, i, F.lit(1))) - 1
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        code = F.regexp_replace(value, " ", "")
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    pattern, needed = PATTERNS[kind]
    may = F.contains(text, F.lit(needed)) if needed else F.lit(True)
    may = may & (F.contains(text, F.lit("@")) if kind == "email" else text.rlike(IBAN_START if kind == "iban" else "[0-9]"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")

    def scored(chunks: Column, s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.concat_ws(" ", _read(chunks, begin, s["start"] - begin), _read(chunks, s["end"], F.lit(CONTEXT_CHARS)))
        bonus = F.when(near.rlike(rf"(?i)\b(?:{CONTEXT[kind]})\b"), CONTEXT_SCORE).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(F.lit(CONFIDENCE[kind]) + bonus, 2).alias("score"))

    places = _ibans(text, lambda value: _valid(kind, value)) if kind == "iban" else _places(text, pattern, lambda value: _valid(kind, value))
    valid = _let(places, lambda found: F.when(F.size(found) > 0, _let(_chunks(text), lambda chunks: F.transform(found, lambda s: scored(chunks, s)))).otherwise(none))
    if kind not in BASE:
        valid = F.filter(valid, lambda s: s["score"] >= MIN_SCORE)
    return F.when(may, valid).otherwise(none)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one array of (kind, start, end, score) per kind, in columns named after the kinds."""
    rows = only(docs, doc_id=doc_id, text=text).withColumn("text", text_of("text"))
    return rows.select("doc_id", *[_spans(F.col("text"), kind).alias(kind) for kind in KINDS])


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, all spans as text, and the sum of scores."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    both = found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE], F.concat(*BASE).alias("base"), F.concat(*KINDS).alias("every"))
    risk = F.aggregate("every", F.lit(0.0), lambda acc, s: acc + s["score"])
    return both.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("every")).alias("spans"), F.round(risk, 2).alias("risk"))
