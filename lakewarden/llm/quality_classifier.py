"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting gives each feature in turn a shallow tree over its bins, so what is learnt is one
look-up table per feature; afterwards the pairs that explain most of what is left get two-dimensional
tables the same way. A score is the logistic of a sum of table entries, added up as arrays.

The tables are learnt on at most ``SAMPLE_ROWS`` labelled rows (the bound is a parameter), taken in the
order of a hash of the id, one row of each id (the one whose text has the smallest hash); scoring is one scan without a shuffle. Only the text is an input. Empty
and null texts have all features 0 and get a score like any other text. Without labels, or with labels of one
kind only, every score is the smoothed share of label 1. Rows with a null id are scored and are never
learnt from; repeated rows get equal scores.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Words, only, raw, release, salted, separators, slices, small_batches

SAMPLE_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
SLICE = 1 << 18  # bytes of text whose features are worked out at once: some thirty arrays of eight bytes for each
MAX_BINS, PAIR_BINS, PAIRS = 32, 8, 4
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.2, 1.0
NEWLINE = separators((0x0A, 0x0A))
FEATURES = (
    "words", "word_length", "symbols", "capitals", "digits", "shouts", "bars", "same_as_previous", "distinct_words", "repeated_windows",
    "lines", "repeated_lines", "short_words", "longest_word", "odd_endings",
)


def features(texts: pa.Array) -> np.ndarray:
    """One row per text; shares are in [0, 1], counts are logarithms."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]).astype(float)
    count = lambda text_of: np.bincount(text_of, minlength=n).astype(float)
    words, lines = Words(data, offsets, BLANKS), Words(data, offsets, NEWLINE)
    size, many = np.maximum(1, sums(np.ones(len(data), bool))), np.maximum(1, words.counts)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, high = (data >= 48) & (data <= 57), data >= 128
    usual = upper | lower | digit | high | BLANKS[data] | np.isin(data, np.frombuffer(b".,;:?'\"()-", np.uint8))
    length = words.ends - words.starts
    last = data[np.maximum(words.ends - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    odd = np.isin(last, np.frombuffer(b"!#$%&*|<>=~^_@\\/+{}[]", np.uint8))
    same = np.zeros(len(words.starts), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
    first_seen = np.unique(words.hashes ^ salted(words.text), return_index=True)[1]
    at, windows = words.windows(3)
    window_seen = np.unique(windows ^ salted(words.text[at]), return_index=True)[1]
    line_seen = np.unique(lines.hashes ^ salted(lines.text), return_index=True)[1]
    longest = np.zeros(n)
    np.maximum.at(longest, words.text, length)
    return np.stack([
        np.log1p(words.counts), count(np.repeat(words.text, length)) / many, sums(~usual) / size, sums(upper) / np.maximum(1, sums(upper | lower)), sums(digit) / size,
        sums(data == 33) / size, sums(data == 124) / size, count(words.text[same]) / many, count(words.text[first_seen]) / many,
        1 - count(words.text[at][window_seen]) / np.maximum(1, count(words.text[at])), np.log1p(lines.counts), 1 - count(lines.text[line_seen]) / np.maximum(1, lines.counts),
        count(words.text[length <= 3]) / many, np.log1p(longest), count(words.text[odd]) / many,
    ], 1) if n else np.zeros((0, len(FEATURES)))


def _steps(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree of at most three leaves over ordered bins: the value of each bin."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    gain = lambda a, b: a * a / (b + RIDGE)
    cuts: list[int] = []
    for _ in range(2):
        edges = [0, *sorted(c + 1 for c in cuts), len(grad)]
        best = (1e-9, -1)
        for a, b in zip(edges, edges[1:]):
            g0, h0 = (g[a - 1], h[a - 1]) if a else (0.0, 0.0)
            inner = np.arange(a, b - 1)
            if len(inner):
                gl, hl = g[inner] - g0, h[inner] - h0
                gr, hr = g[b - 1] - g[inner], h[b - 1] - h[inner]
                won = gain(gl, hl) + gain(gr, hr) - gain(g[b - 1] - g0, h[b - 1] - h0)
                won[(hl < 0.05) | (hr < 0.05)] = -1
                i = int(won.argmax())
                if won[i] > best[0]:
                    best = (float(won[i]), int(inner[i]))
        if best[1] < 0:
            break
        cuts.append(best[1])
    out = np.zeros(len(grad))
    edges = [0, *sorted(c + 1 for c in cuts), len(grad)]
    for a, b in zip(edges, edges[1:]):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + RIDGE)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-dimensional table into four: its gain, and the value of each cell."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best = (-1.0, 0, 0)
    parts = lambda s, i, j: np.array([s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]])
    for i, j in itertools.product(range(grad.shape[0] - 1), range(grad.shape[1] - 1)):
        a, b = parts(g, i, j), parts(h, i, j)
        won = float((a * a / (b + RIDGE)).sum())
        if won > best[0]:
            best = (won, i, j)
    out = np.zeros(grad.shape)
    if best[0] > 0:
        _, i, j = best
        for rows in (slice(0, i + 1), slice(i + 1, None)):
            for cols in (slice(0, j + 1), slice(j + 1, None)):
                out[rows, cols] = grad[rows, cols].sum() / (hess[rows, cols].sum() + RIDGE)
    return best[0], out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables: features in turn, then the pairs that matter most."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges, model.pair_edges = _edges(x, MAX_BINS), _edges(x, PAIR_BINS)
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-9)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _steps(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)))
            table += step
            total += step[bins[f]]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def cells(a: int, b: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], values, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    ranked = sorted(((_quadrants(cells(a, b, g), cells(a, b, h))[0], a, b) for a, b in itertools.combinations(range(x.shape[1]), 2) if min(sizes[a], sizes[b]) > 1), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = RATE * _quadrants(cells(a, b, g), cells(a, b, h))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled rows outside fold 0, at most ``sample_rows`` of them."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").filter(fold("_id") != 0)
    sample = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, size=SLICE):
            x = features(part.column(0))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["_id", "y", "at", "x"])

    rows = only(docs, doc_id=doc_id, text=text)
    # the sample has at most sample_rows rows of two numbers
    joined = rows.join(F.broadcast(sample), rows["doc_id"] == F.col("_id")).select("text", "_id", F.col("_y").alias("y"), F.xxhash64("text").alias("at"))
    measured = joined.mapInArrow(run, f"_id {joined.schema['_id'].dataType.simpleString()}, y int, at long, x array<double>")
    single = measured.groupBy("_id").agg(F.min(F.struct("at", "x", "y")).alias("row"))
    with small_batches(docs.sparkSession):
        got = single.select("row.y", "row.x").toPandas()
    if not len(got):
        return learn(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy(float)
    order = np.lexsort((*x.T[::-1], y))  # sums of doubles come out alike in every run
    return learn(x[order], y[order])


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (rounded to six places) under ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, text, SLICE):
            scores = np.round(shared.value.score(features(part.column(at))), 6)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, doc_id, text)
    rows = with_score(only(docs, doc_id=doc_id, text=text), model)
    return rows.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
