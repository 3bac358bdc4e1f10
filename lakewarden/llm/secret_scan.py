"""Secrets in texts: token patterns, and links between the parts of multipart credentials.

Strong patterns stand alone (assignments, access identifiers, long hex). Weak candidates (random-looking tokens,
user names, key identifiers, endpoints) say nothing by themselves: they become parts of a table of intervals, and an
interval join within scopes of ``SCOPE`` characters of one text keeps those near a complementary part:
a secret near an access identifier, a user name or an endpoint, each of these near a secret. A token has any length from
20 characters on, and what names it (``user=``, ``client_id=``) is no part beside it. Intervals meet on
(text, block of SCOPE characters) and the blocks beside it, so a block holds at most SCOPE characters' worth of
parts however long a text is, and only existence is asked for: no pair is emitted.

Positions are code points, the end exclusive. A null text is empty. Rows are told apart by id and
hash of the text; repeated rows get equal results, rows with a null id too.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HALF_SLICE_BYTES, join_facts, only, release, slices, small_batches, staged, text_of

SCOPE = 400
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: weak candidates, and the roles that must lie near them
ENDPOINT = re.compile(r"(?:https?|s3|postgres(?:ql)?|mysql|redis|mongodb|amqp|ftp)://[^\s\"'<>]+")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
KEY_ID = re.compile(r"""(?<![A-Za-z0-9])(?:(?:ASIA|AIDA|AROA|ABIA|ACCA|AGPA|ANPA)[A-Z0-9]{16,}|(?ai:(?:client|app|tenant|account|access_?key|key)_?id["']?\x20*[:=]\x20*["']?)[A-Za-z0-9._-]{4,})""")
USER = re.compile(r"""(?<![A-Za-z0-9])(?ai:(?:user_?name|user_?id|user|login)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9._@+-]{2,}""")
MIN_ENTROPY = 3.5
NAMED = ("key_id", "user")
LINKED_KINDS = ("opaque", "endpoint", *NAMED)
PARTS = "array<struct<kind:string,role:string,start:int,stop:int>>"


def entropy(token: str) -> float:
    """Bits per character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def opaque(token: str) -> bool:
    """Random-looking: letters of both cases and digits, many different characters."""
    return bool(re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)) and entropy(token) >= MIN_ENTROPY


def parts_of(text: str) -> list[dict]:
    """All parts of one text: base spans (sorted by start, then kind) and weak candidates."""
    found = []
    low = text.lower() if "=" in text or ":" in text else ""
    if low and any(w in low for w in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [("assign", "secret", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", "access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", "secret", m.start(), m.end()) for m in HEX.finditer(text)]
    found.sort(key=lambda p: (p[2], BASE.index(p[0])))
    if "://" in text:
        found += [("endpoint", "endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    taken = sorted((p[2], p[3]) for p in found)
    covers = list(itertools.accumulate((b for _, b in taken), max))
    for m in OPAQUE.finditer(text):
        before = bisect.bisect_left(taken, (m.end(),))
        if opaque(m[0]) and not (before and covers[before - 1] > m.start()):
            found.append(("opaque", "secret", m.start(), m.end()))
    found += [("key_id", "access", m.start(), m.end()) for m in KEY_ID.finditer(text)]
    if low and ("user" in low or "login" in low):
        found += [("user", "user", m.start(), m.end()) for m in USER.finditer(text)]
    return [dict(zip(("kind", "role", "start", "stop"), p)) for p in found]


def find_parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, parts of every row: one scan."""
    rows = only(docs, doc_id=doc_id, text=text).select("doc_id", text_of("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("role", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        release()
        for part in slices(batches, size=HALF_SLICE_BYTES):
            texts = part.column(1).to_pylist()
            keys = [hashlib.md5(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.string()), pa.array([parts_of(t) for t in texts], kind)], ["doc_id", "text_key", "parts"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key string, parts {PARTS}")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """text_key, kind, start, stop of the weak candidates with a complementary part within ``scope`` characters.

    Links depend on the text alone, so equal texts are looked at once.
    """
    weak = found.filter(F.exists("parts", lambda p: p["kind"].isin(*LINKED_KINDS))).select("text_key", "parts").dropDuplicates(["text_key"])
    parts = weak.select("text_key", F.explode("parts").alias("p")).select("text_key", "p.*")
    asks = parts.filter(F.col("kind").isin(*LINKED_KINDS))
    needs = F.when(F.col("role") != "secret", F.array(F.lit("secret"))).otherwise(F.array(F.lit("access"), F.lit("endpoint"), F.lit("user")))
    block = F.floor(F.col("start") / scope)
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("stop") + scope) / scope))
    asks = asks.withColumn("need", F.explode(needs)).withColumn("block", F.explode(reach))
    # an offer lies in every block it covers, so long parts are found from their ends too
    offers = parts.withColumn("_block", F.explode(F.sequence(block, F.floor(F.col("stop") / scope)))).select(F.col("text_key").alias("_key"), F.col("kind").alias("_kind"), F.col("role").alias("_role"), F.col("start").alias("_start"), F.col("stop").alias("_stop"), "_block")
    near = (F.col("_start") - F.col("stop") <= scope) & (F.col("start") - F.col("_stop") <= scope)
    named = F.col("kind").isin(*NAMED) | F.col("_kind").isin(*NAMED)
    near = near & (~named | (F.col("_start") >= F.col("stop")) | (F.col("start") >= F.col("_stop")))
    met = asks.join(offers, (F.col("text_key") == F.col("_key")) & (F.col("need") == F.col("_role")) & (F.col("block") == F.col("_block")) & near, "left_semi")
    return met.select("text_key", "kind", "start", "stop").distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key, base and spans (arrays of kind, start, stop in order of start, then kind) of every row."""
    with small_batches(docs.sparkSession):
        found = staged(find_parts(docs, doc_id, text))
    links = linked(found, scope).groupBy("text_key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("links"))
    shape = lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["stop"].alias("stop"))
    base = F.transform(F.filter("parts", lambda p: p["kind"].isin(*BASE)), shape)
    rank = F.create_map(*[x for i, k in enumerate((*BASE, *LINKED_KINDS)) for x in (F.lit(k), F.lit(i))])
    order = lambda p: F.struct(p["start"].alias("start"), rank[p["kind"]].alias("rank"), p["kind"].alias("kind"), p["stop"].alias("stop"))
    both = F.concat(base, F.coalesce("links", F.array().cast("array<struct<kind:string,start:int,stop:int>>")))
    return join_facts(found, links, ["text_key"]).select("doc_id", "text_key", base.alias("base"), F.transform(F.array_sort(F.transform(both, order)), shape).alias("spans"))


def shown(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def masked(text: str, spans: list, mark: str) -> str:
    """``text`` with the leftmost of overlapping ``spans`` replaced by ``mark`` and the rest of the others left out."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at: s["start"]], mark]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])


def _masked(mark: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, s, mark) for t, s in zip(texts, spans)], dtype=object)

    return run


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; texts without spans are untouched."""
    spans = scan(docs, doc_id, text).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_key"])
    keyed = docs.withColumn("_md5", F.md5(text_of(text).cast("binary")))
    met = keyed.join(spans, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_key")), "left")
    found = F.col("_spans").isNotNull()
    clean = _masked(mark)(F.when(found, F.col(text)), F.col("_spans"))  # other texts are not sent
    changed = met.withColumn(text, F.when(found, clean).otherwise(F.col(text)))
    return changed.select(*docs.columns)
