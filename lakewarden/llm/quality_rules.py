"""Quality rules: simple counts, and the log-likelihood ratio of hashed n-grams between a trusted
target and the raw corpus.

Byte n-grams of every text are counted into a fixed number of hash buckets, once over all documents
(the raw corpus) and once over the trusted ones. A document's score is the mean over its n-grams of
log(p_target / p_raw) of the smoothed multinomials, so it does not depend on length; it is kept
when the score reaches a fixed threshold. Each task adds its counts into one array of the bucket
count, so what is shuffled and what is broadcast is bounded by tasks and buckets.

A null or empty text has no words and fails the base rule. Without trusted documents every score
is 0 and only the base rule decides. Repeated rows count as often as they occur and get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Words, only, raw, salted, separators, slices

GRAM = 3
BUCKETS = 1 << 16
SMOOTHING = 1.0
THRESHOLD = -0.5
BROADCAST_IDS = 2_000_000
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NEWLINE = separators((0x0A, 0x0A))


def _buckets(data: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte; those across two texts are dropped by the caller."""
    h = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(257) + data[j: len(h) + j]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams within texts, and the first and number of them by text."""
    every = _buckets(data, buckets)
    counts = np.maximum(0, np.diff(offsets) - GRAM + 1)
    first = np.cumsum(counts) - counts
    return every[np.repeat(offsets[:-1] - first, counts) + np.arange(counts.sum())], first, counts


def gram_counts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target over all documents; ``trusted`` holds the ids (doc_id) of the target."""
    ids = trusted.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct().withColumn("_hit", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for part in slices(batches):
            data, offsets = raw(part.column(0))
            hit = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            grams, _, counts = _grams(data, offsets, buckets)
            total[0] += np.bincount(grams, minlength=buckets)
            total[1] += np.bincount(grams[np.repeat(hit, counts)], minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "raw", "target"])

    rows = only(docs, doc_id=doc_id, text=text)
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # beyond that, texts and ids meet in a shuffle
    ids = F.broadcast(ids) if few else ids
    marked = rows.join(ids, rows["doc_id"] == F.col("_id"), "left").select("text", F.coalesce("_hit", F.lit(False)).alias("hit"))
    counted = marked.mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(p_target / p_raw) by bucket; at most ``buckets`` rows come to the driver."""
    got = counts.toPandas()
    raw_n, target_n = np.zeros(buckets), np.zeros(buckets)
    raw_n[got["bucket"]], target_n[got["bucket"]] = got["raw"], got["target"]
    if not target_n.sum():
        return np.zeros(buckets)
    share = lambda n: (n + smoothing) / (n.sum() + smoothing * buckets)
    return np.log(share(target_n) / share(raw_n))


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where the same key occurs elsewhere too."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def apply_rules(docs: DataFrame, llr: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base verdict, score and verdict of every row, in one scan."""
    buckets = len(llr)
    shared = docs.sparkSession.sparkContext.broadcast(llr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in slices(batches):
            data, offsets = raw(part.column(1))
            n = part.num_rows
            words = Words(data, offsets, BLANKS)
            sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            word_chars = sums(~BLANKS[data] & ((data & 0xC0) != 0x80))
            symbols = sums(SYMBOLS[data])
            lines = Words(data, offsets, NEWLINE)
            has_word = np.searchsorted(words.starts, lines.starts) < np.searchsorted(words.starts, lines.ends)
            of, hashes = lines.text[has_word], lines.hashes[has_word]
            later = np.ones(len(of), bool)
            later[np.unique(hashes ^ salted(of), return_index=True)[1]] = False
            dup_lines = np.bincount(of[later], minlength=n)
            first, windows = words.windows(3)
            twice = first[_repeats(windows ^ salted(words.text[first]))]
            covered = np.zeros(len(words.starts) + 3, bool)
            for j in range(3):
                covered[twice + j] = True
            repeated = np.bincount(words.text[covered[: len(words.starts)]], minlength=n)
            grams, at, counts = _grams(data, offsets, buckets)
            score = np.diff(np.concatenate([[0.0], np.cumsum(table[grams])])[np.append(at, len(grams))]) / np.maximum(1, counts)
            failed = (words.counts < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * words.counts)
            score = np.round(score, 6)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(x.astype(np.int64)) for x in (words.counts, word_chars, symbols, dup_lines, repeated)], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"],
            )

    rows = only(docs, doc_id=doc_id, text=text)
    longs = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {longs}, base_failed boolean, kept boolean, llr double")


def quality_rules(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs`` judged against the multinomials of its own corpus and of ``trusted`` (doc_id)."""
    return apply_rules(docs, ratios(gram_counts(docs, trusted, doc_id, text, buckets), buckets), doc_id, text, threshold)
