"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenised and cut once; pieces are range-sorted by length and ranked within it, in
parallel. Pieces of one length are interchangeable and so are gaps of one size, so a round works on
runs: (length, ranks from-to) and (gap, sequences from-to). There are at most ``capacity`` lengths whatever the
input, so the run tables stay small. In a round

1. one sweep over sizes in ascending order matches every gap with its largest waiting piece that
   fits (each piece's nearest successor among the gaps); runs that want the same gaps are served by rank,
   the longer piece first;
2. matched gaps shrink, and, when the pieces left have more tokens than the gaps have room, the longest of
   them open as many new sequences as the rest needs at least;

until no piece is left. The plan, a table of runs, is then joined with the ranked pieces. A null or empty text is
the separator alone. Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import numbered
from .bpe import encoder
from .common import HALF_SLICE_BYTES, only, raw, slices, small_batches, staged

CAPACITY = 2048
SEPARATOR = 0
BROADCAST_RUNS = 200_000


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and the separator; longer ones cut, the first piece the short one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in slices(batches, size=HALF_SLICE_BYTES):
            ids, at = bpe.encode(*raw(part.column(1)))
            n = np.diff(at) + 1
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            short = (n - 1) % capacity + 1
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[row], capacity)
            flat = np.insert(ids, at[1:], SEPARATOR).astype("<u4")
            data, begin = memoryview(flat.tobytes()), ((at[:-1] + np.arange(len(n)))[row] + start).tolist()
            crc = [zlib.crc32(data[4 * b: 4 * (b + m)]) for b, m in zip(begin, length.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *[pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = only(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset): ranks go to consecutive sequences at one offset."""
    left = {length: n for length, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def put(length: int, n: int, first: int, offset: int, into: dict[int, list[tuple[int, int]]]) -> None:
        runs.append((length, done[length], done[length] + n, first, offset))
        done[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
        if gap := capacity - offset - length:
            into.setdefault(gap, []).append((first, n))

    while left:
        after: dict[int, list[tuple[int, int]]] = {}
        before = len(runs)
        waiting: list[list[int]] = []  # lengths in ascending order with what is free in this sweep
        lengths = iter(sorted(left))
        upcoming = next(lengths, None)
        for gap in sorted(gaps):
            while upcoming is not None and upcoming <= gap:
                waiting.append([upcoming, left[upcoming]])
                upcoming = next(lengths, None)
            for first, n in gaps[gap]:
                while n and waiting:
                    take = min(n, waiting[-1][1])
                    put(waiting[-1][0], take, first, capacity - gap, after)
                    first, n = first + take, n - take
                    waiting[-1][1] -= take
                    if not waiting[-1][1]:
                        waiting.pop()
                if n:
                    break  # nothing fits gaps this small, now or later
        # gaps that took nothing had no piece to take: pieces only get fewer, so they stay as they are
        gaps = after
        rest = sum(length * n for length, n in left.items())
        free = sum(gap * n for gap, spans in gaps.items() for _, n in spans)
        need = max(0, -(-(rest - free) // capacity))
        if not need and len(runs) == before:  # the gaps would do, but none fits
            need = -(-rest // capacity)
        for length in sorted(left, reverse=True):
            if not need:
                break
            take = min(need, left[length])
            put(length, take, sequences, 0, gaps)
            sequences, need = sequences + take, need - take
    return runs


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    with small_batches(spark):
        cut = staged(pieces(docs, path, doc_id, text, capacity))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity)
    # as an Arrow table: a list of rows would pass through Python workers of its own, with a daemon that stays on every executor
    table = spark.createDataFrame(pa.table(list(np.array(runs, np.int64).reshape(-1, 5).T.copy()), ["length", "lo", "hi", "first", "offset"]))
    if len(runs) <= BROADCAST_RUNS:
        table = F.broadcast(table)
    ranked = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"])
    met = ranked.join(table, "length").filter((F.col("_pos") >= F.col("lo")) & (F.col("_pos") < F.col("hi")))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("_pos") - F.col("lo")).alias("sequence_id"), "offset")
