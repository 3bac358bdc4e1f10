"""Raw metadata events -> enriched events -> catalog tables, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, catalog
from ..operators.store import FoldedTable
from ..session import scratch_dir
from ..sources import sinks
from .streams import run_available


def enrich_to_topic(events: DataFrame, folder: str, delay: str = "10 minutes") -> str:
    """Enriches a stream of raw events; one JSON message per event goes to ``folder``, a sub-folder per batch."""
    out = assembly.enriched_events(events, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        messages = sinks.as_messages(batch, F.col("event_id"), "enriched-metadata-events")
        messages.select("value").write.mode("overwrite").text(f"{folder}/topic/{batch_id}")

    run_available(out, write, f"{folder}/checkpoint")
    return f"{folder}/topic"


class CatalogIngest:
    """foreachBatch target: folds the assets and columns of enriched events into the catalog's tables, a version per batch.

    A repeated batch replaces its own version, also after a restart with the same root.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or scratch_dir(spark, "catalog")
        nothing = spark.createDataFrame([], assembly.ENRICHED_EVENT)
        self.asset_table = FoldedTable(spark, self.root, "assets", "fqn", assembly.STAMP, assembly.ASSET_FIXED, assembly.ASSET_MEASURED, assembly.asset_rows(nothing).schema)
        self.column_table = FoldedTable(spark, self.root, "columns", "fqn", assembly.STAMP, ("asset_fqn",), [c for c in assembly.COLUMN_FIELDS if c != "asset_fqn"], assembly.column_rows(nothing).schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        events = batch.persist()
        self.asset_table.write(assembly.asset_rows(events), batch_id)
        self.column_table.write(assembly.column_rows(events), batch_id)
        events.unpersist()

    def run(self, events: DataFrame) -> CatalogIngest:
        run_available(events, self, f"{self.root}/checkpoint")
        return self

    @property
    def version(self) -> int:
        """The newest version that both tables have."""
        return min(self.asset_table.last_version(), self.column_table.last_version())

    def assets(self, patches: DataFrame | None = None) -> DataFrame:
        """One row per asset; ``patches`` (fqn, field, value, ts, seq) are the stewards' edits, which no hydration undoes."""
        rows = self.asset_table.read(self.version)
        return rows if patches is None else catalog.apply_patches(rows, patches)

    def columns(self) -> DataFrame:
        """The columns of every asset as its newest event lists them; those of earlier events are gone."""
        stamp = F.struct(*assembly.STAMP)
        newest = self.asset_table.read(self.version).select(F.col("fqn").alias("asset_fqn"), stamp.alias("_newest"))
        return self.column_table.read(self.version).join(newest, "asset_fqn").filter(stamp == F.col("_newest")).drop("_newest")
