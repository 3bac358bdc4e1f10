"""Exact duplicates by progressive refinement: length, then prefix hash, then hash of the full text.

A first scan counts (length, hash of the first 256 characters); the length is part of the key, so
texts alone in their length or prefix fall out. The surviving keys set bits of a bitmap of fixed size
that is broadcast; a second scan hashes the full text only of rows whose bit is set (a chance
hit costs one hash, nothing else). Texts never move: what is shuffled is one narrow row per document.

Of equal texts the row with the largest id stays; of repeated rows with that id exactly one. A null
text is an empty text. A null id loses to every other; in a group of null ids one row stays, with
keep_id null. Texts are equal when their SHA-256 is. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_facts, only, staged, text_of

PREFIX_CHARS = 256
BITMAP_BITS = 1 << 23
BROADCAST_ROWS = 500_000


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: bool = False, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the digest only of rows that needed one
    unless ``digests`` asks for all."""
    rows = only(docs, doc_id=doc_id, text=text).withColumn("text", text_of("text"))
    keyed = rows.select("doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix"))
    suspects = keyed.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spot = F.pmod(F.xxhash64("size", "prefix"), F.lit(bitmap_bits))
    bitmaps = (
        suspects.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    chosen = F.expr("(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int) >> cast(bit % 8 as int)) & 1")
    marked = keyed.select("*", F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit"))
    # at most bitmap_bits / 32768 rows of 4 KB, whatever the input
    suspected = marked.join(F.broadcast(bitmaps), "bucket", "left").withColumn("suspect", F.coalesce(chosen == 1, F.lit(False)))
    full = F.sha2(F.col("text").cast("binary"), 256)
    hashed = staged(suspected.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), full.alias("digest") if digests else F.when(F.col("suspect"), full).alias("digest"),
        F.when(~F.col("suspect"), F.concat_ws("-", F.hex("prefix"), F.col("size"))).alias("alone"), F.col("suspect"),
    ))
    # a row that is no suspect is the only one with its length and prefix hash
    key = F.coalesce("alone", "digest").alias("key")
    hashed = hashed.select("doc_id", "row", "digest", key)
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row")).alias("best")
    groups = hashed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best).filter("n > 1")
    return join_facts(hashed, groups, ["key"]).select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns, of any type.

    Up to ``BROADCAST_ROWS`` rows that go are told to the tasks that hold the texts, which stay where they are; more meet them in
    a shuffle. Of rows with one id and one text the one whose other columns have the smallest hash stays.
    """
    decided = exact_dedup(docs, doc_id, text).filter("group_size > 1")
    groups = staged(decided.groupBy(F.col("doc_id").alias("_dedup_id"), F.col("text_sha256").alias("_dedup_sha")).agg(F.max("kept").alias("_dedup_kept"), F.count(F.lit(1)).alias("_dedup_rows")))
    hashed = docs.withColumn("_dedup_text_sha", F.sha2(text_of(text).cast("binary"), 256))
    same = F.col(doc_id).eqNullSafe(F.col("_dedup_id")) & (F.col("_dedup_text_sha") == F.col("_dedup_sha"))
    bounded = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    out = hashed.join(bounded(groups.filter("not _dedup_kept or _dedup_rows > 1").select("_dedup_id", "_dedup_sha")), same, "left_anti").select(*docs.columns)
    several = groups.filter("_dedup_kept and _dedup_rows > 1").select("_dedup_id", "_dedup_sha")
    if several.isEmpty():
        return out
    rest = F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != text])))
    repeats = hashed.join(bounded(several), same).withColumn("_dedup_n", F.row_number().over(Window.partitionBy(doc_id, "_dedup_text_sha").orderBy(rest)))
    return out.unionByName(repeats.filter("_dedup_n = 1").select(*docs.columns))
