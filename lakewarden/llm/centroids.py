"""Centroid clustering of integer vectors by equal-average equal-variance search.

Components become integers ``floor(scale * x)``. Centroids are sorted by the mean of their components. A vector
starts at its own mean and goes outward: ``dim * (mean difference)**2`` is a lower bound of the squared distance
that grows along the way, so the search ends once it exceeds the best distance; adding
``(difference of deviations)**2`` rejects single centroids on the way. Only what both inequalities leave
is computed, in whole numbers. Bounds are doubles lowered by more than their rounding, so results are exact.

Each round sends one row per task, cluster and component; sums are cut into limbs, so they are exact at any size.
Nothing else leaves the tasks: the driver holds ``k`` centroids.

Kept are vectors with exactly ``dim`` components, none null or non-finite; others have no row in the result. A null
id counts as an empty one for the choice of seeds; equal hashes are ordered by components. Repeated rows are
vectors of their own. Fewer than ``k`` kept vectors make as many centroids, none (an empty table) no rows. Centroids that
tie go to the smaller number. A distance or sum beyond a long is null; the cluster is right all the same. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, staged

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
TAME = 1 << 27  # whole numbers up to this keep squared distances of up to 128 components in 64 bits
LIMB = 40
ROUNDING = 1e-12
LONGEST = (1 << 63) - 1


class Centroids:
    """The sorted centroids of one round."""

    def __init__(self, points: list[list[int]]):
        self.points = points
        self.dim = len(points[0]) if points else 0
        mean = np.array([_ratio(sum(p), self.dim) for p in points])
        order = np.argsort(mean, kind="stable")
        self.number, self.mean = order, mean[order]
        self.deviation = np.array([_deviation(points[i]) for i in order])
        self.tame = np.array([max(map(abs, points[i])) < TAME for i in order], bool)
        self.whole = np.array([points[i] if tame else [0] * self.dim for i, tame in zip(order, self.tame)], np.int64).reshape(len(points), self.dim)

    def exact(self, x: list[int]) -> tuple[int, int]:
        """Nearest centroid of one vector in numbers of any size: (number, squared distance)."""
        distance, number = min((sum((a - b) ** 2 for a, b in zip(x, p)), i) for i, p in enumerate(self.points))
        return number, distance

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; components are below ``TAME``."""
        n, last = len(x), len(self.mean)
        mean = x.sum(1) / self.dim
        deviation = np.sqrt(((x - mean[:, None]) ** 2).sum(1))
        best, number = np.full(n, LONGEST, np.int64), np.full(n, last, np.int64)
        right = np.searchsorted(self.mean, mean)
        left, live, odd = right - 1, np.arange(n), np.zeros(n, bool)
        while len(live):
            l, r, m = left[live], right[live], mean[live]
            below = np.where(l >= 0, m - self.mean[np.maximum(l, 0)], np.inf)
            above = np.where(r < last, self.mean[np.minimum(r, last - 1)] - m, np.inf)
            lower = below <= above
            j = np.where(lower, l, r)
            gap = np.where(lower, below, above)
            inside = np.isfinite(gap)
            live, j, gap, lower = live[inside], j[inside], gap[inside], lower[inside]
            near = np.maximum(0, gap - ROUNDING * (np.abs(mean[live]) + np.abs(self.mean[j]) + 1))
            with np.errstate(over="ignore"):
                bound = self.dim * near * near
            going = bound <= best[live]  # all further means are further away
            live, j, bound, lower = live[going], j[going], bound[going], lower[going]
            left[live[lower]] -= 1
            right[live[~lower]] += 1
            spread = np.maximum(0, np.abs(deviation[live] - self.deviation[j]) - ROUNDING * (deviation[live] + self.deviation[j] + 1))
            with np.errstate(over="ignore"):
                open_ = ~(bound + spread * spread > best[live])
            row, j = live[open_], j[open_]
            odd[row[~self.tame[j]]] = True
            row, j = row[self.tame[j]], j[self.tame[j]]
            distance = ((x[row] - self.whole[j]) ** 2).sum(1)
            c = self.number[j]
            better = (distance < best[row]) | ((distance == best[row]) & (c < number[row]))
            best[row[better]], number[row[better]] = distance[better], c[better]
        for i in np.flatnonzero(odd | (number == last)).tolist():
            c, distance = self.exact(x[i].tolist())
            number[i], best[i] = c, min(distance, LONGEST)
            odd[i] = distance > LONGEST
        return number, np.where(odd & (best == LONGEST), -1, best)


def _ratio(a: int, b: int) -> float:
    try:
        return a / b
    except OverflowError:
        return math.copysign(math.inf, a)


def _deviation(p: list[int]) -> float:
    """Root of the sum of squared differences from the mean."""
    square = len(p) * sum(v * v for v in p) - sum(p) ** 2
    return math.isqrt(square) / math.sqrt(len(p)) if square.bit_length() > 900 else math.sqrt(square / len(p))


def whole(values: np.ndarray, scale: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """floor(scale * x) of each row, and rows with a component of ``TAME`` or more as whole numbers of any size."""
    values = values.astype(np.float64)
    wide = (np.abs(values) >= (TAME - 1) / scale).any(1)
    tame = np.floor(np.where(wide[:, None], 0.0, values) * scale).astype(np.int64)
    return tame, {i: [math.floor(Fraction(v) * scale) for v in values[i].tolist()] for i in np.flatnonzero(wide).tolist()}


def _rows(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray, dict[int, list[int]]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0), *whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)


def _assigned(model: Centroids, tame: np.ndarray, wide: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    number, distance = model.nearest(tame)
    far = {}
    for i, x in wide.items():
        number[i], far[i] = model.exact(x)
        distance[i] = far[i] if far[i] <= LONGEST else -1
    return number, distance, far


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number; digits of many numbers may be summed place by place."""
    place = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    yield place, value


def _sums(vectors: DataFrame, model: Centroids, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and componentwise sums of each non-empty cluster."""
    k, dim = len(model.points), model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), object), [0] * k
        for _, tame, wide in _rows(batches, dim, scale):
            number, _, _ = _assigned(model, tame, wide)
            for c in np.unique(number).tolist():
                mine = number == c
                counts[c] += int(mine.sum())
                sums[c] += tame[mine].sum(0).astype(object)
            for i, x in wide.items():
                sums[number[i]] += np.array(x, object)
        made = [(c, d, place, digit) for c in range(k) if counts[c] for d in range(dim + 1) for place, digit in limbs(counts[c] if d == dim else int(sums[c, d]))]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "component", "place", "digit"])

    added = vectors.mapInArrow(run, "cluster int, component int, place int, digit bigint").groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit"))
    totals: dict[int, list[int]] = {}
    for r in added.collect():  # k * (dim + 1) rows for each limb
        totals.setdefault(r["cluster"], [0] * (dim + 1))[r["component"]] += r["digit"] << (LIMB * r["place"])
    return {c: (t[dim], t[:dim]) for c, t in totals.items()}


def kept(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """vec_id, vector of the rows that take part."""
    rows = only(embeddings, vec_id=vec_id, vector=vector).withColumn("vector", F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(F.coalesce((F.size("vector") == dim) & finite, F.lit(False)))


def seeds(vectors: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hash of ``1:<vec_id>``."""
    ranked = vectors.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("hash"), "vector")
    return [[math.floor(Fraction(v) * scale) for v in r["vector"]] for r in ranked.orderBy("hash", "vector").limit(k).collect()]


def cluster(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = embeddings.sparkSession
    vectors = kept(embeddings, vec_id, vector, dim)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    points = seeds(vectors, k, scale)
    for _ in range(rounds if points else 0):
        for c, (n, sums) in _sums(vectors, Centroids(points), scale).items():
            points[c] = [s // n for s in sums]
    model = Centroids(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tame, wide in _rows(batches, dim, scale):
            number, distance, _ = _assigned(model, tame, wide)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance, mask=distance < 0)], ["vec_id", "cluster", "distance"])

    found = staged(vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")) if points else vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    # the driver gets one row for each of the k clusters
    sums = {r["cluster"]: r["sum"] for r in found.groupBy("cluster").agg(F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("sum")).collect()}
    fits = lambda n: None if n is None or n > LONGEST else int(n)
    inertia = fits(None if None in sums.values() else sum(sums.values()))
    facts = [(c, fits(n), inertia, hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for c, n in sums.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
