"""A group of near copies joins by pivots instead of pair by pair."""

import random

import brute

from lakewarden.llm import jaccard_join


def test_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    random.seed(8)
    n, base = 260, [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(random.choice([1, 2, 2, 3, 3])):  # pairs lie on both sides of the threshold
            words[random.randrange(150)] = f"x{random.randrange(1 << 30)}"
        rows.append((i, " ".join(words)))
    met = []
    likely = jaccard_join._likely

    def counted(sketches, pairs, threshold):
        met.append(pairs.distinct().count())
        return likely(sketches, pairs, threshold)

    monkeypatch.setattr(jaccard_join, "_likely", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [brute.shingle_set(t) for _, t in rows]
    component = list(range(n))
    links = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(n):
        before = list(component)
        for i, j in links:
            component[i] = component[j] = min(component[i], component[j])
        if component == before:
            break
    assert got == dict(enumerate(component))
    assert n * n // 8 < len(links) < n * n // 2 - n and sum(met) < n * n // 4
