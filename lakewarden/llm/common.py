"""Shared by the operators: text slices of bounded size, and hashes of words and word windows.

Python code runs inside Spark tasks over Arrow batches. A batch is worked on in slices of
about ``SLICE_BYTES`` of text, so memory does not depend on how long a batch's texts are;
one longer text is a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

SLICE_BYTES = 1 << 20
HALF_SLICE_BYTES = 1 << 19  # where tasks of a step leave little memory beside them
TABLES = ("documents", "labels", "pages", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Jobs run inside have this setting; what it was before holds again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder, read by everything that follows.

    A table rather than a checkpoint: its plan carries nothing of the one that made it, so loops that
    stage each round plan as fast in the last round as in the first. The shuffle files of the writing job go
    when it ends, as the table holds what they held; else all rounds' files stay until the driver collects its garbage.
    """
    folder = scratch_dir(df.sparkSession, "llm-stage")
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


ROWS_PER_TASK = 100_000


def few(df: DataFrame) -> bool:
    """Rows of ids that one task holds with ease (a few MB), so that a shuffle into many partitions would cost more than it spreads."""
    return df.count() <= ROWS_PER_TASK


def gathered(df: DataFrame, together: bool) -> DataFrame:
    """In one partition, whose groups and joins need no shuffle, when its rows are ``few``; as it is otherwise."""
    return df.coalesce(1) if together else df


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> contextlib.AbstractContextManager[None]:
    """Jobs run inside exchange Arrow batches of about ``size`` bytes: ten thousand rows of texts or lists would be some 20 to 100 MB in every task."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def release() -> None:
    """Drops the encoders that tasks of an earlier step left in this Python worker: Spark hands workers on, and they hold some 300 MB each."""
    bpe = sys.modules.get("lakewarden.llm.bpe")
    if bpe is not None and bpe.encoder.cache_info().currsize:
        bpe.encoder.cache_clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # freed pages go back only where the C library can be told so
            ctypes.CDLL("libc.so.6").malloc_trim(0)


HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``facts`` (one row per key) when a key may hold a third of all rows.

    Keys of at least one in ``HOT_SHARE`` rows, so no more than ``HOT_SHARE`` of them, have their facts
    broadcast and their rows stay where they are; all others meet in a shuffle. ``rows`` is read three times.
    """
    least = max(100, rows.count() // HOT_SHARE + 1)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    warm = marked.filter(F.col("_hot")).join(F.broadcast(facts.join(F.broadcast(hot.drop("_hot")), keys, "left_semi")), keys, "left")
    return marked.filter(F.col("_hot").isNull()).join(facts, keys, "left").unionByName(warm).drop("_hot")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under fixed names, so that others of ``df`` cannot clash."""
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes of ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(first, last - first)
            first = last


_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)
_BYTE = np.random.RandomState(7).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.RandomState(11).randint(0, 1 << 63, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all of them (one-to-one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n + (n >> 1), 1 << 16) if n <= 4 * SLICE_BYTES else n
        made = []
        for base in (_ROOT, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if n > 4 * SLICE_BYTES:  # a single huge text: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


class Hashed:
    """64-bit hash of any byte range of ``data`` in constant time (polynomial over prefix sums)."""

    def __init__(self, data: np.ndarray):
        power, self._back = _power(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64, out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64))


def salted(numbers: np.ndarray) -> np.ndarray:
    """64 random-looking bits for each small number."""
    return mix(numbers.astype(np.uint64) + np.uint64(_ROOT))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first: last + 1] = True
    return out


BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class Words:
    """Maximal runs of bytes that are no separators: where they lie, their hashes, and the words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        inside = ~separator[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        opens[heads] |= inside[heads]
        self.starts = np.flatnonzero(opens)
        stop = np.ones(len(data) + 1, bool)
        stop[:-1] = ~inside | opens
        stops = np.flatnonzero(stop)
        self.ends = stops[np.searchsorted(stops, self.starts, "right")] if len(self.starts) else self.starts
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hashes = Hashed(data)(self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``k`` words within one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.text[:n] == self.text[k - 1:])
        return first, combined(self.hashes, first, k)


def combined(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    total = np.full(len(first), k, np.uint64)
    for j in range(k):
        total += hashes[first + j] * _STEP[j]
    return mix(total)


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a word sequence of any length below ``k``."""
    return combined(hashes, np.zeros(1, np.int64), len(hashes))[0]


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)
