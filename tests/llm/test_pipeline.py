"""The pipeline, each stage held to plain Python on its own input."""

import brute

import corpus_pipeline
from lakewarden.llm.common import table

ROOT = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, ROOT, "documents")
    columns = docs.columns
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, ROOT).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "best_fit_packing":
            got = [tuple(r) for r in docs.select("doc_id", "piece", "start", "length", "ids_crc32").collect()]
            assert sorted(got) == sorted(brute.pieces(list(before.items())))
            continue
        assert docs.columns == columns
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "exact_dedup":
            largest = {}
            for d, t in before.items():
                largest[t] = max(d, largest.get(t, d))
            assert set(texts) == set(largest.values())
        elif name == "ngram_jaccard_join":
            assert set(texts) == {c for _, _, c in brute.op1(list(before.items()))}
        elif name == "secret_scan":
            assert set(texts) == set(before)
            for d, t in before.items():
                clean = brute.op10([(d, t)])[0][1:4] == (0, 0, 0)
                assert not clean or texts[d] == t or "://" in t or any(c.isdigit() for c in t)
                assert clean or ("[secret]" in texts[d] and brute.op10([(d, texts[d])])[0][2:4] == (0, 0))
        else:
            labels = {r["doc_id"]: r["quality"] for r in table(spark, ROOT, "labels").collect()}
            known = [(d in texts, labels[d] == 1) for d in before if d in labels]
            assert sum(a == b for a, b in known) / len(known) >= 0.95
