"""The classifier's sample when documents repeat ids."""

from lakewarden.llm import quality_classifier


def test_repeated_ids_keep_both_labels(spark):
    def text(i):
        return "a plain text of some words that goes on" if i % 2 else "### $$$ BUY!!! NOW!!! ### ###"

    docs = spark.createDataFrame([(i, f"{text(i)} {copy % 2}") for i in range(200) for copy in range(6)] + [(7, text(7))] * 3000, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, sample_rows=100)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.with_score(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 2 == 1) for i in range(200))
    assert abs(model.base) < 1
