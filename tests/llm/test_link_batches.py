"""Operator 12 passes its links in small batches."""

import brute
import pyarrow as pa
from test_edges import TEXTS

from lakewarden.llm import alignment


def test_links_come_in_small_pieces():
    lists = pa.array([[1] * 5, None, [2] * 40, [], [3] * 6, [4] * 6], pa.list_(pa.int64()))
    before, alignment.SLICE_LINKS = alignment.SLICE_LINKS, 12
    try:
        found = list(alignment._by_links(iter([pa.RecordBatch.from_arrays([lists], ["links"])])))
    finally:
        alignment.SLICE_LINKS = before
    assert [(p.num_rows, n.tolist(), len(x)) for p, n, x in found] == [(2, [5, 0], 5), (1, [40], 40), (3, [0, 6, 6], 12)]


def test_op12_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 2000)
    monkeypatch.setattr(alignment, "SLICE_LINKS", 50)
    sizes = spark.sparkContext.accumulator(0)
    seen = alignment._by_links

    def most(batches, links="links"):
        for batch in batches:
            sizes.add(int(batch.nbytes > 20_000))
            yield from seen([batch], links)

    rows = [(i, f"{t} " + "many small words in a row " * 20) for i, t in enumerate(TEXTS * 4) if t]
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(alignment, "_by_links", most)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert sorted(map(tuple, alignment.align(df).collect())) == sorted(brute.op12(rows))
    assert sizes.value <= 2 * sum(len(t) > 2500 for _, t in rows) and spark.conf.get(name) == before
