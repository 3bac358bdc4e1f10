"""The report over the whole lake, and metrics of more batches than Spark remembers."""

from lakewarden.operators import profiling
from lakewarden.plans.flagship import lake_report, sample_values
from lakewarden.sources.readers import LAKE_TABLES, lake
from lakewarden.streaming import streams


def test_report_covers_every_table(spark):
    root = "/root/testdata/sf0.001"
    report = lake_report(spark, root).collect()
    assert {r["table_name"] for r in report} == set(LAKE_TABLES)
    assert len({(r["table_name"], r["column_name"]) for r in report}) == len(report)
    samples = {(r["table_name"], r["column_name"]): r["sample_values"] for r in sample_values(lake(spark, root, ("region", "documents"))).collect()}
    assert samples["region", "r_name"] == ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    assert len(samples["documents", "text"]) == 5 and not any(v.startswith("sha256:") for v in samples["documents", "text"])


def test_metrics_of_every_batch(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    spark.range(50).repartition(5).write.parquet(path)
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 2).parquet(path)
    with streams.Metrics(spark, str(tmp_path / "metrics")) as heard:
        done = streams.run_available(stream, lambda batch, _id: None, checkpoint)  # a writer that looks at nothing
        heard.write(str(done.runId))
    rows = streams.metrics_table(spark, str(tmp_path / "metrics")).orderBy("batch_id").collect()
    assert [r.batch_id for r in rows] == [0, 1, 2] and all(r.end_offset is not None and r.batch_seconds > 0 for r in rows)
    files = spark.read.parquet(path).select("_metadata.file_path").distinct().toDF("path")
    left = streams.file_backlog(spark, checkpoint, files).orderBy("batch_id").collect()
    assert [(r.batch_id, r.files, r.files_left) for r in left] == [(0, 2, 3), (1, 2, 1), (2, 1, 0)]
    assert {r.metric for r in streams.lag_gauges(streams.metrics_table(spark, str(tmp_path / "metrics"))).collect()} >= {"rows_per_second", "state_rows"}


def test_offset_lag():
    assert streams.offset_lag('{"t": {"0": 5, "1": 7}}', '{"t": {"0": 9, "1": 7, "2": 3}}') == 7
    assert streams.offset_lag('{"logOffset": 3}', '{"logOffset": 5}') == 2 and streams.offset_lag("4", "9") == 5
    assert streams.offset_lag(None, "9") is None and streams.offset_lag("x", "9") is None


def test_sketches_of_new_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda: {"t": spark.read.parquet(path)}
    make = lambda a, b: spark.range(a, b).selectExpr("id", "id % 7 AS k", "CAST(NULL AS STRING) AS s").coalesce(1).write.mode("append").parquet(path)
    make(0, 2000)
    first = profiling.added_sketches(table(), None)
    first.write.parquet(str(tmp_path / "a"))
    make(1000, 4000)
    stored = spark.read.parquet(str(tmp_path / "a"))
    second = profiling.added_sketches(table(), stored)
    assert second.select("file").distinct().count() == 1 and second.agg({"rows": "max"}).first()[0] == 3000
    got = {r.column_name: (r.rows, r.distinct_count) for r in profiling.merged_distinct(stored.unionByName(second)).collect()}
    assert got["k"] == (5000, 7) and got["s"] == (5000, 0) and abs(got["id"][1] - 4000) < 120
