"""Catalog tables that many batches write: folded rows in hash buckets, one version per batch.

A row's state is a fold of its events that does not depend on their order: the event with the smallest stamp
gives the fields a later hydration must not change, the one with the greatest stamp the measured ones. So a batch only
appends its own folded rows, under the bucket of their key, and reading folds what a bucket holds. A late older event, a
repeated one and any other batching of the same events end in the same table, and what a batch writes depends on
the batch alone. Buckets that have gathered ``MOST_PARTS`` parts are folded into one part by the batch that touches them next.

A version's manifest names the parts of every bucket (at most buckets * MOST_PARTS rows). It is written last: a
version without one does not exist, and a batch that is repeated replaces its own version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
MOST_PARTS = 8
FIRST, LAST = "_first", "_last"


class FoldedTable:
    """One table under ``root``. ``stamp`` columns order the events of a key; ``fixed`` fields come from its first event, ``measured`` ones from its last."""

    def __init__(self, spark: SparkSession, root: str, name: str, key: str, stamp: Sequence[str], fixed: Sequence[str], measured: Sequence[str], schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.root, self.name, self.key = spark, root, name, key
        self.stamp, self.fixed, self.measured, self.buckets = list(stamp), list(fixed), list(measured), buckets
        part = lambda names: T.StructType([schema[c] for c in [*self.stamp, *names]])
        self.stored = T.StructType([schema[key], T.StructField(FIRST, part(self.fixed)), T.StructField(LAST, part(self.measured)), T.StructField("bucket", T.IntegerType())])

    # ---- versions -------------------------------------------------------------
    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/{self.name}-manifest/v={version}"

    def manifest(self, version: int) -> list[tuple[int, int]]:
        """(bucket, version of a part) of one version, bounded by buckets * MOST_PARTS; nothing before the first."""
        if version < 0:
            return []
        rows = self.spark.read.schema("bucket int, part bigint").parquet(self._manifest_path(version)).collect()
        return sorted((r["bucket"], r["part"]) for r in rows)

    def last_version(self) -> int:
        """The newest version that is complete, -1 for none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.name}-manifest")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return -1
        done = [f.getPath() for f in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max((int(p.getName().split("=")[1]) for p in done), default=-1)

    def _parts(self, parts: Sequence[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.stored)
        base = f"{self.root}/{self.name}"
        paths = [f"{base}/v={v}/bucket={b}" for b, v in parts]
        return self.spark.read.option("basePath", base).schema(T.StructType([*self.stored.fields, T.StructField("v", T.LongType())])).parquet(*paths).drop("v")

    # ---- folding --------------------------------------------------------------
    def lifted(self, events: DataFrame) -> DataFrame:
        """Events as rows of the stored shape, with their bucket."""
        part = lambda names: F.struct(*self.stamp, *names)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        return events.select(self.key, part(self.fixed).alias(FIRST), part(self.measured).alias(LAST), bucket.alias("bucket"))

    def fold(self, rows: DataFrame) -> DataFrame:
        """One row per key; a partial aggregate, so no key is hot however many events it has."""
        order = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in self.stamp])
        return rows.groupBy("bucket", self.key).agg(F.min_by(FIRST, order(FIRST)).alias(FIRST), F.max_by(LAST, order(LAST)).alias(LAST)).select(self.key, FIRST, LAST, "bucket")

    def write(self, events: DataFrame, version: int, previous: int | None = None) -> None:
        """Version ``version``: the parts of the one before it, and the rows of ``events``."""
        before = self.manifest(version - 1 if previous is None else previous)
        rows = self.fold(self.lifted(events))
        held: dict[int, int] = {}
        for bucket, _ in before:
            held[bucket] = held.get(bucket, 0) + 1
        full = {b for b, n in held.items() if n >= MOST_PARTS}
        if full:
            touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most as many as there are buckets
            full &= touched
            rows = self.fold(rows.unionByName(self._parts([p for p in before if p[0] in full])))
        path = f"{self.root}/{self.name}/v={version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        files = self.spark.read.schema(self.stored).parquet(path)
        made = {r["bucket"] for r in files.select("bucket").distinct().collect()}
        parts = [p for p in before if p[0] not in full and p[1] != version] + [(b, version) for b in sorted(made)]
        self.spark.createDataFrame(parts, "bucket int, part bigint").coalesce(1).write.mode("overwrite").parquet(self._manifest_path(version))

    # ---- reading --------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        """key, fixed fields of the first event, measured fields and stamp of the last."""
        rows = self.fold(self._parts(self.manifest(self.last_version() if version is None else version)))
        return rows.select(self.key, *[F.col(f"{FIRST}.{c}").alias(c) for c in self.fixed], *[F.col(f"{LAST}.{c}").alias(c) for c in [*self.stamp, *self.measured]])
