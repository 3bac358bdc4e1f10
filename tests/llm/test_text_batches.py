"""Near copies are found over small Arrow batches, and the session's setting is put back."""

from lakewarden.llm import jaccard_join

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_go_to_the_workers_in_small_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"a b c d e f g {'x' * 900} {i % 3}") for i in range(60)] + [(60, None), (None, "a b")], "doc_id long, text string").coalesce(1)
    before = spark.conf.get(NAME, None)
    wanted = sorted(map(str, jaccard_join.jaccard_join(rows).collect()))
    seen = []
    profile = jaccard_join.profile

    def noted(*args):
        seen.append(int(spark.conf.get(NAME)))
        return profile(*args)

    monkeypatch.setattr(jaccard_join, "profile", noted)
    assert sorted(map(str, jaccard_join.jaccard_join(rows).collect())) == wanted
    assert seen == [4 << 20] and spark.conf.get(NAME, None) == before


def test_encoders_of_an_earlier_step_are_dropped():
    from lakewarden.llm import bpe, common

    bpe.encoder(bpe.vocabulary_path())
    assert bpe.encoder.cache_info().currsize
    common.release()
    common.release()
    assert not bpe.encoder.cache_info().currsize
