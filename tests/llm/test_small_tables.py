"""What many rounds over few rows leave behind: shuffle files, and tasks that a shuffle of a few rows is spread over."""

import time

import pytest

from lakewarden.llm import common, jaccard_join

WIDE = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def wide(spark):
    before = {k: spark.conf.get(k) for k in WIDE}
    for k, v in WIDE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def tasks(spark, group):
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
    return sum(s.numCompletedTasks for s in stages if s)


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString("\n").split("\n") if b.startswith("shuffle_")}


def test_staged_leaves_no_shuffle_files(wide):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(wide), wide.conf.get(name)
    df = wide.range(5000).selectExpr("id % 300 as k").groupBy("k").count()
    out = common.staged(df)
    for _ in range(50):
        if not (left := shuffle_files(wide) - before):
            break
        time.sleep(0.2)
    assert not left
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect())) and wide.conf.get(name) == setting


LINKS = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (200, 205), (203, 205), (203, 204), (200, 205)]
STARS = sorted([(i, 0) for i in range(1, 41)] + [(101, 100), (203, 200), (204, 200), (205, 200)])


@pytest.mark.parametrize("most", [common.ROWS_PER_TASK, 0])
def test_components_of_few_and_of_many_links(wide, monkeypatch, most):
    monkeypatch.setattr(common, "ROWS_PER_TASK", most)
    links = wide.createDataFrame(LINKS, "a long, b long").repartition(4)
    group = f"components-{most}-{time.time()}"
    wide.sparkContext.setJobGroup(group, group)
    try:
        found = jaccard_join.components(links)
    finally:
        wide.sparkContext.setJobGroup("", "")
    assert sorted(map(tuple, found.collect())) == STARS
    assert not most or tasks(wide, group) < 250
    assert jaccard_join.components(links.limit(0)).collect() == []


@pytest.mark.parametrize("most", [common.ROWS_PER_TASK, 0])
def test_pairs_of_few_and_of_many_rows(wide, monkeypatch, most):
    monkeypatch.setattr(common, "ROWS_PER_TASK", most)
    monkeypatch.setattr(jaccard_join, "ROWS_PER_TASK", most)
    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words), " ".join([*words[:99], "x"]), " ".join([*words[:60], *["y"] * 60]), " ".join(words[10:])]
    rows = wide.createDataFrame([*enumerate(texts), (7, texts[0]), (7, texts[2])], "doc_id long, text string")
    pairs = wide.createDataFrame([(1, 0, False), (2, 0, False), (3, 0, True), (7, 0, False), (7, 2, True)], "a long, b long, large boolean")
    got = jaccard_join._compared(rows, common.staged(pairs), jaccard_join.K, jaccard_join.THRESHOLD)
    assert sorted(map(tuple, got.collect())) == [(1, 0), (3, 0), (7, 0), (7, 2)]
