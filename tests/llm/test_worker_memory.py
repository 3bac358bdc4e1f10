"""What keeps the memory of Python workers small: small Arrow batches, encoders dropped, caches in arrays."""

import numpy as np

import corpus_pipeline
from lakewarden.llm import bpe, packing, quality_classifier, secret_scan

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS = [(i, f"some words of a text {i} password = abcdef{i} {'y' * (i % 7)}") for i in range(40)] + [(40, None), (None, "a b"), (3, "a b")]


def documents(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")


def test_tasks_that_need_no_encoder_drop_it_first(spark, monkeypatch):
    calls = {m: spark.sparkContext.accumulator(0) for m in (quality_classifier, secret_scan)}
    for module, count in calls.items():
        monkeypatch.setattr(module, "release", lambda count=count: count.add(1))
    quality_classifier.fit(documents(spark), labels(spark))
    secret_scan.find_parts(documents(spark)).collect()
    assert all(count.value >= 1 for count in calls.values())


def test_whole_texts_go_to_the_workers_in_small_batches(spark, monkeypatch):
    before, seen = spark.conf.get(NAME, None), []
    for module in (packing, secret_scan, corpus_pipeline):
        def noted(df, keep=module.staged):
            seen.append(int(spark.conf.get(NAME)))
            return keep(df)

        monkeypatch.setattr(module, "staged", noted)
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: labels(s))
    packed = packing.pack(documents(spark), bpe.vocabulary_path())
    assert packed.count() == len(ROWS) and packing.pack(documents(spark).limit(0), bpe.vocabulary_path()).count() == 0
    assert secret_scan.scan(documents(spark)).count() == len(ROWS)
    corpus_pipeline.classified(spark, documents(spark), "")
    assert seen == [4 << 20] * 4 and spark.conf.get(NAME, None) == before


def test_known_numbers_equal_a_dictionary():
    random = np.random.RandomState(5)
    for kind in (np.int64, np.uint64):
        known, plain = bpe.Known(kind), {}
        for _ in range(20):
            keys = np.unique(np.append(random.randint(-(1 << 63), (1 << 63) - 1, 50, dtype=np.int64), [0, -1, 7]).astype(kind))
            random.shuffle(keys)
            found = known(keys)
            assert found.tolist() == [plain.get(k, -1) for k in keys.tolist()]
            new = keys[found < 0]
            numbers = np.arange(len(plain), len(plain) + len(new))
            known.add(new, numbers)
            plain.update(zip(new.tolist(), numbers.tolist()))
        assert len(known) == len(plain)


def test_full_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    small, texts = bpe.Encoder(bpe.vocabulary_path()), [t.encode() for _, t in ROWS if t]
    for text in [*texts, *texts]:
        ids, at = small.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert small.decode(ids).tobytes() == text and at.tolist() == [0, len(ids)]
        again, _ = bpe.encoder(bpe.vocabulary_path()).encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert np.array_equal(ids, again)
