"""Time the headline queries and print one JSON line.

Every query runs to the end: what it returns is written to the ``noop`` sink, so no row goes to the driver. Each query
runs once to warm up and is then timed; the timed run builds the plan anew, with all the jobs it starts itself.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clearwell import build_session  # noqa: E402
from clearwell.plans.registered import all_queries  # noqa: E402

HEADLINE = (
    "profile_numeric", "profile_columns", "profile_rows", "semantic_tags", "fill_median", "dedup_first", "dedup_none",
    "scale_zscore", "run_table", "iqr_outliers", "drift_suite", "apply_repairs", "latest_catalog", "feedback_fold",
    "resolve", "pii_documents", "governance_scan", "resolve_entities", "er_edges", "knn_batch", "simulate_scenarios",
    "ranked_outcomes", "recommend", "revenue_by_region", "kpi_trend", "intent", "stream_rollup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
