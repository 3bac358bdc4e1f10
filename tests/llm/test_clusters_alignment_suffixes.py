"""Operators 11 to 13: registered queries and edge cases against plain Python."""

import math
import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_edges import TEXTS

from lakewarden.llm import alignment, centroids, suffix_dedup
from lakewarden.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
A, B = alignment.vocabulary_path(), alignment.vocabulary_path("piece_bpe_32k.model")


def same(got, wanted):
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{ROOT}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def test_op11(spark):
    t = pq.read_table(f"{ROOT}/embeddings.parquet")
    same(QUERIES["op11_centroid_clustering"](spark, ROOT).collect(), brute.op11(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))))


def test_op11_edges(spark):
    random.seed(1)
    rows = [(i, [random.choice([0.5, -1.25, 3.0, random.gauss(0, 5)]) for _ in range(64)]) for i in range(120)]
    rows += [(3, [1e30] * 64), (4, [1e300] + [0.0] * 63), (None, [0.1] * 64), (None, None), (9, [math.nan] * 64), (10, [None] * 64), (11, [1.0] * 63), (12, [math.inf] * 64), (5, [0.0] * 64), (5, [0.0] * 64)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cluster int, distance double").repartition(3)
    same(centroids.cluster(df).collect(), brute.op11(rows))
    assert centroids.cluster(df.limit(0)).collect() == [] and centroids.cluster(df.filter("size(embedding) = 63")).collect() == []
    few = rows[:3]
    same(centroids.cluster(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect(), brute.op11(few))


def test_op11_bounds_reject_and_ties_go_to_the_smaller_number():
    random.seed(2)
    points = [[random.randrange(-200, 200) for _ in range(8)] for _ in range(12)]
    points[7] = points[2]
    model = centroids.Centroids(points)
    x = np.array([[random.randrange(-220, 220) for _ in range(8)] for _ in range(500)] + points, np.int64)
    number, distance = model.nearest(x)
    assert [(n, d) for n, d in zip(number.tolist(), distance.tolist())] == [model.exact(r) for r in x.tolist()]
    assert 7 not in number.tolist()


def test_op12(spark, docs):
    same(QUERIES["op12_token_alignment"](spark, ROOT).collect(), brute.op12(docs))


ODD = [" ", "  ", "a ", "a  ", " ▁ x", "x▁y", "<s> </s> <unk><0x41>", "\x00\x01 \x00", "ａｂ ﬁ é", "\n \n", "tab\t x", " lead", "🎉" * 50, "中文 字符", "<|endoftext|> x"]


def test_op12_edges(spark):
    rows = [*enumerate([*TEXTS, *ODD]), (None, "a b"), (3, None), (7, TEXTS[7])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_a int, links int").repartition(3)
    same(alignment.align(df).collect(), brute.op12(rows))
    assert alignment.align(df.limit(0)).collect() == [] and alignment.overlaps(df.limit(0), A, B).collect() == []
    broken = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text union all select 2L, 'a b'")
    assert sorted(map(tuple, alignment.groups(broken, A, B).select("doc_id", "n_a", "n_b", "groups_sha256").collect())) == [(1, 0, 0, ""), (2, 2, 2, brute.sha("257|263;275|289"))]


def test_op12_overlaps(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[3:9])], "doc_id long, text string")
    wanted = []
    for d, t in enumerate(TEXTS[3:9]):
        spans = []
        for side in brute.two_sided(t):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            spans.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
        wanted += [(d, n, m, i, j, e == f) for n, (i, s, e) in enumerate(spans[0]) for m, (j, r, f) in enumerate(spans[1]) if s < f and r < e]
    same(alignment.overlaps(df, A, B).collect(), wanted)


def test_op12_links_are_bounded():
    a, b = alignment.plain_encoder(A), alignment.pieces(B)
    assert alignment.most_links(a, b) < 1_000_000


def test_op13(spark, docs):
    same(QUERIES["op13_suffix_dedup"](spark, ROOT).collect(), brute.op13(docs))


@pytest.mark.parametrize(("most_runs", "block_bytes"), [(10_000, 4 << 20), (1, 20_000)])
def test_op13_edges(spark, monkeypatch, most_runs, block_bytes):
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most_runs)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(suffix_dedup, "COLLECTION_BYTES", 20_000)
    random.seed(3)
    base = "".join(random.choice("ab ") for _ in range(4000))
    rows = [*enumerate(TEXTS), (None, "a b" * 40), (3, None), (90, "a b" * 40), (2, "x" * 300), (95, "x" * 50), (96, "x" * 49), (97, "y" + "x" * 120 + "é" * 60), (5, "é" * 80), (200, base[:51]), (201, base[100:149] + base[:49]), (7, TEXTS[7])]
    for _ in range(60):
        a, n, m = random.randrange(3900), random.randrange(20, 200), random.randrange(3900)
        rows.append((random.randrange(300, 340), base[a: a + n] + base[m: m + 60]))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, block int").repartition(3)
    same(suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect(), brute.op13(rows))
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_op13_spans_and_bytes(spark):
    shared = "0123456789" * 6
    df = spark.createDataFrame([(1, "a" + shared), (2, "bb" + shared[:55] + "c" + shared + "d"), (3, shared[1:50])], "doc_id long, text string")
    found = {r["doc_id"]: ([tuple(s) for s in r["spans"]], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeats(df).collect()}
    assert found == {1: ([], "a" + shared), 2: ([(2, 57), (58, 118)], "bbcd"), 3: ([], shared[1:50])}


def test_op13_suffix_order_against_sorting():
    random.seed(5)
    data = bytes(random.choice(b"ab") for _ in range(600))
    ends = np.arange(12, 601)
    at, new = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), ends, 6)
    strings = [data[e - 12: e] for e in ends.tolist()]
    found = [data[a: a + 12] for a in at.tolist()]
    assert sorted(found) == found == sorted(s for s in strings if strings.count(s) > 1)
    assert new.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(len(found))]


def test_large_sets_link_on_both_sides_of_the_threshold(spark):
    from lakewarden.llm import jaccard_join

    n = 300_000  # elements; c of them differ in the second text
    base = [f"a{i}" for i in range(n + 4)]

    def changed(c):
        return base[: n - c] + [f"z{i}" for i in range(c + 4)]

    # n - c of n + c shingles are shared, and four more around the seam differ: least c at which the pair no longer reaches the threshold
    limit = next(c for c in range(n // 9 - 10, n) if 100 * (n - c - 4) < 80 * (n + c + 4))
    rows = [(1, " ".join(base)), (2, " ".join(changed(limit - 1))), (3, " ".join(["q", *base[5:], *[f"y{i}" for i in range(limit + 60)]]))]
    sets = {d: brute.shingle_set(t) for d, t in rows}
    linked = {(i, j): 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i, j in ((1, 2), (1, 3), (2, 3))}
    assert linked[1, 2]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert (got[1] == got[2]) and (got[3] == 1) == (linked[1, 3] or linked[2, 3])


def test_drop_duplicates_of_any_columns(spark):
    from lakewarden.llm import exact_dedup

    bare = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None), (None, ""), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, exact_dedup.drop_duplicates(bare).collect()))) == sorted(map(repr, [(2, "a"), (3, None), (None, "b")]))
    odd = spark.createDataFrame([(7, "x", {"k": 1}, [1.0]), (7, "x", {"k": 2}, None), (6, "x", None, None), (8, "y", None, None)], "doc_id long, text string, m map<string,int>, _n array<double>")
    kept = exact_dedup.drop_duplicates(odd).collect()
    assert sorted(r["doc_id"] for r in kept) == [7, 8] and kept[0].asDict().keys() == {"doc_id", "text", "m", "_n"}
