"""The registered queries over given tables against plain Python."""

import brute
import pyarrow.parquet as pq
import pytest

from lakewarden.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"


def run(spark, name, columns):
    return sorted((tuple(r) for r in QUERIES[name](spark, ROOT).select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{ROOT}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def same(got, wanted):
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_op1(spark, docs):
    got = [(repr(d), n, c) for d, n, c in run(spark, "op1_ngram_jaccard_join", ["doc_id", "n_shingles", "component_id"])]
    same(got, brute.op1(docs))


def test_op2(spark, docs):
    same(run(spark, "op2_license_scan", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]), brute.op2(docs))


def test_op2_labels_keep_base(spark):
    for base, labels, n, score in run(spark, "op2_license_scan", ["base_labels", "labels", "n_base", "score"]):
        assert set(base.split(",")) - {""} <= set(labels.split(",")) and 0 <= score <= 1 and (score > 0) == (labels != "")


def test_op3(spark, docs):
    same(run(spark, "op3_bpe_round_trip", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]), brute.op3(docs))


def test_op4_held_out_accuracy(spark):
    root = ROOT.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{root}/labels.parquet").to_pylist()}
    got = QUERIES["op4_quality_classifier"](spark, root).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op6(spark, docs):
    same(run(spark, "op6_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]), brute.op6(docs))


def test_op7(spark):
    for page, text, n in run(spark, "op7_html_extraction", ["page_id", "text", "n_chars"]):
        assert len(text) == n and "©" not in text and "track(" not in text and "<p>" not in text


def test_op8(spark, docs):
    rows = run(spark, "op8_best_fit_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    same([r[:5] for r in rows], brute.pieces(docs))
    sequences = {}
    for r in rows:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * (sum(r[3] for r in rows) / 2048) + 1


def test_op9(spark, docs):
    same(run(spark, "op9_quality_rules", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]), brute.op9(docs))


def test_op10(spark, docs):
    same(run(spark, "op10_secret_scan", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]), brute.op10(docs))
