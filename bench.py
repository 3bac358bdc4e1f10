"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed; results go to the no-op sink, so every
row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakewarden.plans import QUERIES  # noqa: E402
from lakewarden.plans.flagship import lake_report  # noqa: E402
from lakewarden.session import build_session  # noqa: E402

HEADLINE = (
    "b10_full_profile", "b3_approx_distinct", "b7_frequent_values", "a10_foreign_keys", "c7_table_scores", "d7_classified_columns",
    "d11_pii_assets", "d16_value_scan", "e6_suggested_terms", "f2_domains", "g1_asset_upsert", "g8_catalog_stats", "h1_idempotent_append",
    "i2_policy_as_written", "j5_impact", "j10_dag_levels", "l5_held_alerts", "l7_budget_burn", "m6_customer_360", "m11_fraud_features", "k2_catalog_ingest",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = os.environ.get("BENCH_WARM", "1") == "1"
    wanted = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {"flagship_lake_report": lake_report, **{name: QUERIES[name] for name in (wanted or HEADLINE)}}
    times, cold = {}, {}
    for name, fn in jobs.items():
        for attempt in range(2 if warm else 1):
            start = time.perf_counter()
            fn(spark, root).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            cold.setdefault(name, times[name])
    print(json.dumps({
        "metric": "governance_headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold,
        "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "shuffle_partitions": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
