"""Similarity join of word n-gram sets by Jaccard, size-aware and heavy-light.

Small sets enumerate subsets of a fixed size: sets of sizes a and b reach the threshold exactly when they
share a subset of ``overlap(a, b)`` elements, so both write all their subsets of that size under the key
(a, b, subset), and who meets there is linked without further check. Large sets scan inverted
lists of their rarest elements (prefixes): a pair that reaches the threshold meets in at least
one list. Which sets count as small is decided by cost: subsets written against list entries read.

Equal sets are one class first. A list does not emit its pairs: it compares its members with one pivot
of the list, links are verified on whole sets and contracted to components, and each list that
still holds several components goes on, with four times as many pivots out of its largest component, until its open pairs are
no more than a few per member, as few as the pivots would make, or two turns in a row joined hardly any of its components;
the pairs left are then compared one by one. So a group of n near copies costs a few times n comparisons, while no
pair of a list is left out unless both ends are in one component already.

Sets hold 64-bit hashes of shingles. A text with fewer than ``k`` words is one shingle of all its words; a
text without words, or null, has an empty set and is linked with nothing. Rows with one id are one document:
their links count for it. A row with a null id has a null component and no links. Repeated rows are kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, HALF_SLICE_BYTES, ROWS_PER_TASK, Words, combined, few, gathered, join_facts, lowered, mix, only, raw, release, signed, slices, small_batches, staged, whole

K = 5
THRESHOLD = Fraction(4, 5)
MOST_SMALL = 16
FREQUENT_SHARE = 1000
SKETCH_WORDS, SKETCH_BITS = 4, 1  # least words of a sketch, bits per element
SLACK = 4
LARGE = 10_000  # sets above this have chance hits among 32 bits too many to tell anything
PAIRS_PER_ROW = 8
BLOCK_SHINGLES = 1_000_000  # held at once by a task that looks for frequent ones
LEAST_GAIN = 0.02  # share of a list's components that a turn must join with others for another to be worth its while
BROADCAST_IDS = 2_000_000


def overlap(a: int, b: int, t: Fraction = THRESHOLD) -> int:
    """Least intersection of sets of sizes a and b whose Jaccard similarity is t or more."""
    return math.ceil(t * (a + b) / (1 + t))


def partners(a: int, t: Fraction = THRESHOLD) -> range:
    return range(math.ceil(t * a), math.floor(a / t) + 1)


def shingles(words: Words, text: int, k: int = K) -> np.ndarray:
    """The sorted distinct shingle hashes of one text of a slice."""
    a, b = words.bounds[text], words.bounds[text + 1]
    if b - a >= k:
        return np.unique(combined(words.hashes, np.arange(a, b - k + 1), k))
    return np.array([whole(words.hashes[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64)


def _frequent(rows: DataFrame, n: int, k: int) -> np.ndarray:
    """Shingles in at least one of ``FREQUENT_SHARE`` documents: at most FREQUENT_SHARE times the mean set size.

    Blocks of texts report what is frequent in them; a shingle frequent in all is frequent in some block.
    This only orders the lists, no pair depends on it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, texts = [], 0

        def report() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            least = math.ceil(max(4, texts / (2 * FREQUENT_SHARE)))
            often = np.unique(values[: max(0, len(values) - least + 1)][values[least - 1:] == values[: max(0, len(values) - least + 1)]])
            counts = np.searchsorted(values, often, "right") - np.searchsorted(values, often, "left")
            return pa.RecordBatch.from_arrays([pa.array(signed(often)), pa.array(counts)], ["shingle", "n"])

        for part in slices(batches, size=HALF_SLICE_BYTES):
            data, offsets = raw(part.column(0))
            words = Words(lowered(data), offsets, BLANKS)
            held += [shingles(words, i, k) for i in range(part.num_rows)]
            texts += part.num_rows
            if sum(map(len, held)) > BLOCK_SHINGLES:
                yield report()
                texts = 0
        if held:
            yield report()

    counted = rows.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") >= max(8, n // FREQUENT_SHARE)).orderBy("n", "shingle").select("shingle").toPandas()["shingle"].to_numpy()
    return found.astype(np.int64)


def _ordered(s: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The elements of a set, rarest first: those not frequent by value, then the frequent ones by rank."""
    e = signed(s)
    if len(often) and len(e):
        j = np.minimum(np.searchsorted(often, e), len(often) - 1)
        e = e[np.lexsort((e, np.where(often[j] == e, rank[j], 0)))]
    return e


def profile(rows: DataFrame, frequent: Broadcast, k: int = K) -> DataFrame:
    """doc_id, n, hi, lo (128 bits naming the set), sketch, small (the elements of sets of up to MOST_SMALL) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        order = np.argsort(frequent.value)
        often, rank = frequent.value[order], order + 1
        for part in slices(batches, size=HALF_SLICE_BYTES):
            data, offsets = raw(part.column(1))
            words = Words(lowered(data), offsets, BLANKS)
            out: list[list] = [[] for _ in range(5)]
            for i in range(part.num_rows):
                s = shingles(words, i, k)
                n = len(s)
                hi, lo = signed(np.array([np.add.reduce(mix(s ^ np.uint64(17))), np.add.reduce(mix(s + np.uint64(29)))], np.uint64)).tolist()
                width = 64 * SKETCH_WORDS << max(0, math.ceil(math.log2(max(1, n) * SKETCH_BITS / (64 * SKETCH_WORDS))))
                bits = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                sketch = np.packbits(bits).view(np.int64).tolist()
                for column, value in zip(out, (n, hi, lo, sketch, _ordered(s, often, rank).tolist() if n <= MOST_SMALL else [])):
                    column.append(value)
            longs, lists = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(out, (longs, longs, longs, lists, lists))]], ["doc_id", "n", "hi", "lo", "sketch", "small"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, hi bigint, lo bigint, sketch array<bigint>, small array<bigint>")


def _entries(rows: DataFrame, frequent: Broadcast, least: int, k: int, threshold: Fraction) -> DataFrame:
    """token, doc, n, pos: the rarest elements of every set of ``least`` or more, as many as a partner must meet one of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        order = np.argsort(frequent.value)
        often, rank = frequent.value[order], order + 1
        for part in slices(batches, size=HALF_SLICE_BYTES):
            data, offsets = raw(part.column(1))
            words = Words(lowered(data), offsets, BLANKS)
            tokens, sizes, kept = [np.zeros(0, np.int64)], [], []
            for i in range(part.num_rows):
                s = shingles(words, i, k)
                n = len(s)
                keep = n - math.ceil(threshold * n) + 1 if n >= max(1, least) else 0
                tokens.append(_ordered(s, often, rank)[:keep])
                sizes.append(n)
                kept.append(keep)
            kept = np.array(kept)
            row = np.repeat(np.arange(part.num_rows), kept)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), part.column(0).take(pa.array(row)), pa.array(np.array(sizes, np.int32)[row]), pa.array(pos.astype(np.int32))], ["token", "doc", "n", "pos"])

    return rows.mapInArrow(run, f"token bigint, doc {rows.schema['doc_id'].dataType.simpleString()}, n int, pos int")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of the nodes of ``links`` (a, b), but for the least nodes themselves.

    Each round points larger neighbours of a node at its least neighbour, then all smaller ones, so chains
    shrink by half or more; every round is written to the shared folder. It ends when all edges are stars: no node
    has two parents, or is parent and child. Edges that are stars from the start take no round. A round makes no more edges
    than it was given; few edges take their rounds in one partition, without a shuffle.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if together := few(edges):
        edges = staged(edges.coalesce(1))
    while True:
        ends = gathered(edges.select(F.col("a").alias("node"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"))), together)
        loose = ends.groupBy("node").agg(F.sum("child").alias("parents"), F.count(F.lit(1)).alias("n")).agg(F.max((F.col("parents") > 1) | ((F.col("parents") == 1) & (F.col("n") > 1)))).first()[0]
        if not loose:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = gathered(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), together)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        beside = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(gathered(beside.unionByName(lowest.select("a", F.col("m").alias("b"))), together).distinct())


def _subsets(sets: DataFrame, boundary: int, threshold: Fraction) -> DataFrame:
    """key, a, even (both sizes equal), doc of every subset of the fixed size that a partner could share, for sets below the boundary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            docs, keys, sides, even = [], [], [], []
            for doc, elements in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a = len(elements)
                values = mix(np.array(elements, np.int64).view(np.uint64))
                made: dict[int, np.ndarray] = {}
                for b in partners(a, threshold):
                    c = overlap(a, b, threshold)
                    if b >= boundary or c > a or c > b:
                        continue
                    if c not in made:
                        with np.errstate(over="ignore"):
                            made[c] = np.array([mix(values[list(x)]).sum(dtype=np.uint64) for x in itertools.combinations(range(a), c)], np.uint64)
                    tag = np.uint64((min(a, b) << 32) | max(a, b))
                    keys.append(mix(made[c] ^ mix(np.array([tag]))))
                    docs += [doc] * len(made[c])
                    sides += [a] * len(made[c])
                    even += [a == b] * len(made[c])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(sides, pa.int32()), pa.array(even, pa.bool_()), pa.array(docs, part.schema.field(0).type)], ["key", "a", "even", "doc"])

    small = sets.filter((F.col("n") > 0) & (F.col("n") < boundary)).select("doc", "small")
    return small.mapInArrow(run, f"key bigint, a int, even boolean, doc {sets.schema['doc'].dataType.simpleString()}")


def _small_links(sets: DataFrame, boundary: int, threshold: Fraction) -> DataFrame:
    """Links of small sets: under a key (a, b, subset) every set of size a is linked with every one of size b;
    each is linked with the least of the other size (of its own, when sizes are equal), which joins the same sets."""
    rows = staged(_subsets(sets, boundary, threshold))
    sides = rows.groupBy("key", "even", "a").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    keys = sides.groupBy("key", "even").agg(
        F.count(F.lit(1)).alias("sizes"), F.min("a").alias("low"), F.min_by("least", "a").alias("of_low"), F.max_by("least", "a").alias("of_high"), F.min_by("most", "a").alias("most"),
    ).filter((F.col("even") & (F.col("of_low") != F.col("most"))) | (F.col("sizes") == 2))
    met = rows.join(keys.drop("even"), "key")
    other = F.when(F.col("a") == F.col("low"), F.col("of_high")).otherwise(F.col("of_low"))
    return met.select(F.col("doc").alias("a"), other.alias("b")).filter("a <> b").distinct()


def _boundary(sets: DataFrame, threshold: Fraction) -> int:
    """The size below which sets enumerate subsets: where subsets written and list entries read cost least."""
    p, q = threshold.numerator, threshold.denominator
    prefix = F.expr(f"slice(small, 1, cast(n - ({p} * n + {q - 1}) div {q} + 1 as int))")
    few = sets.filter((F.col("n") > 0) & (F.col("n") <= MOST_SMALL)).select("n", F.explode(prefix).alias("token"))
    lists = few.groupBy("token").agg(F.count(F.lit(1)).alias("length"))
    read = {r["n"]: (r["entries"], r["read"]) for r in few.join(lists, "token").groupBy("n").agg(F.count(F.lit(1)).alias("entries"), F.sum("length").alias("read")).collect()}
    count = {r["n"]: r["count"] for r in sets.filter((F.col("n") > 0) & (F.col("n") <= MOST_SMALL)).groupBy("n").count().collect()}

    def subsets(n: int) -> int:
        return sum(math.comb(n, overlap(n, b, threshold)) for b in partners(n, threshold))

    # an entry read may become a pair, whose verification reads a whole set
    scan = {n: read[n][1] * (1 + n) for n in read}
    costs = {x: sum(count.get(n, 0) * subsets(n) for n in range(1, x)) + sum(scan.get(n, 0) for n in range(x, MOST_SMALL + 1)) for x in range(1, MOST_SMALL + 2)}
    return min(costs, key=lambda x: (costs[x], -x))


def _need(na: str, nb: str, threshold: Fraction) -> str:
    """SQL for ``overlap`` of two sizes."""
    p, q = threshold.numerator, threshold.denominator
    return f"(({p} * ({na} + {nb}) + {p + q - 1}) div {p + q})"


def _meets(threshold: Fraction) -> str:
    """SQL: two entries (n, pos) and (n2, pos2) of a list may belong to a pair that reaches the threshold."""
    c = _need("n", "n2", threshold)
    return f"{c} <= least(n, n2) and pos <= n - {c} and pos2 <= n2 - {c}"


def _some(ids: DataFrame) -> DataFrame:
    """Broadcast when the ids are few, joined by a shuffle otherwise."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _elements(rows: DataFrame, asked: DataFrame, k: int, wide: bool) -> DataFrame:
    """The columns of ``asked`` (doc, ...) and the set of each asked document: whole hashes, or 32 bits of each."""
    names = [c for c in asked.columns if c != "doc"]
    met = rows.join(asked.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=HALF_SLICE_BYTES):
            data, offsets = raw(part.column(1))
            words = Words(lowered(data), offsets, BLANKS)
            every = [signed(shingles(words, i, k)) for i in range(part.num_rows)]
            at = np.cumsum([0, *map(len, every)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *every])
            values = flat if wide else (flat >> 32).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.ListArray.from_arrays(pa.array(at), pa.array(values))], ["doc", *names, "elements"])

    fields = [f"{c} {asked.schema[c].dataType.simpleString()}" for c in ("doc", *names)]
    return met.mapInArrow(run, ", ".join([*fields, f"elements array<{'bigint' if wide else 'int'}>"]))


def _compared(rows: DataFrame, pairs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) that reach the threshold, on whole sets.

    The set of a travels to that of b. Sets of up to ``LARGE`` elements go as 32 bits of each hash, which tells all pairs but those
    within ``SLACK`` of the least intersection (chance hits and elements that coincide are about n * n / 2**32); these, and pairs with a
    larger set, go with all 64 bits.
    Up to ``BROADCAST_IDS`` pairs, ids go to the texts; more meet them in a shuffle.
    """
    def met(wanted: DataFrame, wide: bool) -> DataFrame:
        n = wanted.count()
        wanted = gathered(wanted.select("a", "b"), n <= ROWS_PER_TASK)
        sent = F.broadcast if n <= BROADCAST_IDS else (lambda ids: ids)
        left = _elements(rows, sent(wanted.select(F.col("a").alias("doc"), "b")), k, wide).toDF("a", "b", "x")
        right = _elements(rows, sent(wanted.select(F.col("b").alias("doc")).distinct()), k, wide).toDF("b", "y")
        sizes = left.join(right, "b").select("a", "b", F.expr("size(array_intersect(x, y))").alias("common"), F.expr("size(x)").alias("n"), F.expr("size(y)").alias("n2"))
        return sizes.withColumn("over", F.expr(f"common - {_need('n', 'n2', threshold)}"))

    rough = staged(met(pairs.filter("not large"), False).select("a", "b", "over"))
    near = rough.filter(F.abs("over") <= SLACK).select("a", "b").unionByName(pairs.filter("large").select("a", "b"))
    near = staged(gathered(near, few(near)).distinct())
    sure = rough.filter(F.col("over") > SLACK).select("a", "b")
    if near.isEmpty():
        return sure.distinct()
    return sure.unionByName(met(near, True).filter("over >= 0").select("a", "b")).distinct()


def _likely(sketches: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """The distinct pairs (a, b) that sizes and sketches (a lower bound of the difference) do not rule out, and whether a set of them is large."""
    met = pairs.distinct().join(sketches.toDF("a", "n", "s"), "a").join(sketches.toDF("b", "n2", "s2"), "b")
    # parities of hash buckets, a power of two in number: the longer sketch is folded to the shorter one
    fold = lambda x, y: f"case when size({x}) > size({y}) then transform(sequence(1, size({y})), i -> aggregate(sequence(i, size({x}), size({y})), 0L, (acc, j) -> acc ^ {x}[j - 1])) else {x} end"
    met = met.withColumn("f", F.expr(fold("s", "s2"))).withColumn("f2", F.expr(fold("s2", "s")))
    differ = "aggregate(zip_with(f, f2, (x, y) -> bit_count(x ^ y)), 0, (acc, x) -> acc + x)"
    c = _need("n", "n2", threshold)
    return staged(met.filter(f"{c} <= least(n, n2) and {differ} <= n + n2 - 2 * {c}").selectExpr("a", "b", f"greatest(n, n2) > {LARGE} as large").distinct())


def _verified(rows: DataFrame, likely: DataFrame, k: int, threshold: Fraction, every: bool) -> DataFrame:
    """Links among the staged pairs (a, b): of each document with one partner or, with ``every``, as many as join
    the same components as all of them.

    Then the pairs whose ends are still in different components after the first comparison follow, one by one.
    """
    one = staged(gathered(likely, few(likely)).groupBy("a").agg(F.min(F.struct("b", "large")).alias("_b")).select("a", "_b.*"))
    first = staged(_compared(rows, one, k, threshold))
    if not every:
        return first
    known = components(first)
    at = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}"))
    rest = likely.join(at("a"), "a", "left").join(at("b"), "b", "left").filter("coalesce(in_a, a) <> coalesce(in_b, b)").select("a", "b", "large")
    rest = staged(rest.join(one, ["a", "b"], "left_anti"))  # those were compared
    return first if rest.isEmpty() else first.unionByName(_compared(rows, rest, k, threshold))


def _large_links(rows: DataFrame, sketches: DataFrame, frequent: Broadcast, boundary: int, k: int, threshold: Fraction) -> DataFrame | None:
    """Links with a set at or above the boundary, as many as join the same components as all of them."""
    entries = _entries(rows, frequent, math.ceil(threshold * boundary), k, threshold).repartition("token")
    # the count looks at every column, so that it and the join read one and the same shuffle
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("d"), F.max("n").alias("x"), F.max("pos").alias("y")).filter("m > 1 and d is not null and x > 0 and y >= 0").select("token")
    open_ = staged(entries.join(shared, "token").withColumn("comp", F.col("doc")))
    links, turn, before = None, 0, None
    while True:
        size = open_.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", "m").alias("main"), F.sum("m").alias("m"), F.sum(F.col("m").cast("decimal(38,0)") * F.col("m")).alias("mm"))
        size = size.select("token", "m", "main", "comps", ((F.col("m").cast("decimal(38,0)") * F.col("m") - F.col("mm")) / 2).alias("pairs"))
        # components, not rows, tell what a turn did to a list: it keeps its rows as long as one of them is not joined
        if before is not None:
            size = size.join(before, "token", "left").select("token", "m", "main", "comps", "pairs", F.when(F.col("comps") > (1 - LEAST_GAIN) * F.col("was"), F.col("idle") + 1).otherwise(0).alias("idle"))
        else:
            size = size.withColumn("idle", F.lit(0))
        pivots = 4 ** turn  # of the list's largest component, while they cost a quarter of its open pairs at most
        worth = (F.col("pairs") > PAIRS_PER_ROW * F.col("m")) & (F.col("pairs") > 4 * pivots * F.col("comps")) & (F.col("idle") < 2)
        size = staged(size.select("token", "main", F.col("comps").alias("was"), "idle", worth.alias("goes_on")))
        if size.isEmpty():
            return links
        last = turn > 0 and size.filter("goes_on").isEmpty()
        before = size.select("token", "was", "idle")
        entry = ["doc", "n", "pos", "comp"]
        if last:
            other = open_.select("token", *[F.col(c).alias(f"{c}2") for c in entry])
        else:
            asked = open_.join(size.filter("goes_on").select("token", "main"), "token").filter("comp = main") if turn else open_
            # the same order in all lists, so that lists of one group share their pivots
            rank = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("doc", F.lit(turn)) if turn else "doc", *entry))
            other = asked.withColumn("rank", rank).filter(F.col("rank") <= pivots).select("token", *[F.col(c).alias(f"{c}2") for c in entry])
        order = "(n > n2 or (n = n2 and doc > doc2))" if last else "doc <> doc2"
        met = open_.join(other, "token").filter(f"comp <> comp2 and {order} and greatest(n, n2) >= {boundary} and {_meets(threshold)}")
        likely = _likely(sketches, met.select(F.greatest("doc", "doc2").alias("a"), F.least("doc", "doc2").alias("b")), threshold)
        found = _verified(rows, likely, k, threshold, last) if last or not turn else staged(_compared(rows, likely, k, threshold))
        links = found if links is None else links.unionByName(found)
        if last:
            return links
        turn += 1
        known = components(links)
        links = known.toDF("a", "b")  # stars join what the links joined
        marked = open_.drop("comp").join(known, F.col("doc") == F.col("node"), "left").select("token", "doc", "n", "pos", F.coalesce("component", "doc").alias("comp"))
        mixed = marked.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
        open_ = staged(marked.join(mixed, "token"))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    All that reads texts in Python is staged here, in small Arrow batches; what is returned only joins staged tables.
    """
    with small_batches(docs.sparkSession):
        return _joined(docs, doc_id, text, k, threshold)


def _joined(docs: DataFrame, doc_id: str, text: str, k: int, threshold: Fraction) -> DataFrame:
    rows = only(docs, doc_id=doc_id, text=text)
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, rows.count(), k))
    name = ["n", "hi", "lo"]
    profiles = staged(profile(rows, frequent, k))
    classes = staged(profiles.filter("n > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("doc")))
    sets = profiles.join(classes.withColumnRenamed("doc", "doc_id"), ["doc_id", *name]).select(F.col("doc_id").alias("doc"), *name, "small").dropDuplicates(["doc", *name])
    sets = staged(sets.filter(F.col("n") <= MOST_SMALL))
    boundary = _boundary(sets, threshold)
    members = staged(join_facts(profiles.select("doc_id", *name), classes, name))
    several = members.filter("doc is not null and doc_id is not null").groupBy("doc_id").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x <> y")
    parts = [members.join(several, "doc_id").select(F.col("doc").alias("a"), F.col("x").alias("b"))]  # one id, several texts
    if boundary > 1:
        parts.append(_small_links(sets, boundary, threshold))
    copies = members.filter("doc is null or doc_id is null or doc_id <> doc").select("doc_id").distinct().join(classes.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti")
    alone = rows.filter("doc_id is not null").join(_some(copies), "doc_id", "left_anti")
    sketches = profiles.filter("n > 0 and doc_id is not null").select("doc_id", "n", "sketch")
    if (large := _large_links(alone, sketches, frequent, boundary, k, threshold)) is not None:
        parts.append(large)
    links = parts[0]
    for part in parts[1:]:
        links = links.unionByName(part)
    found = components(links)
    met = members.join(found, F.col("doc") == F.col("node"), "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc", "doc_id")).alias("component_id"))
