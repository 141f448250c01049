"""Headline queries on local[BENCH_CPUS] over BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.plans import load  # noqa: E402
from panelspark.session import build_session  # noqa: E402

HEADLINE = (
    "area_panel",
    "supplier_panel",
    "dedup_by_regime",
    "training_mart",
    "series_summary",
    "series_census",
    "feature_frame",
    "movement_class",
    "rolling_baselines",
    "backtest_report",
    "quantile_crps",
    "coherent_vintages",
    "forecast_scorecard",
    "band_scales",
    "data_drift",
    "stationarity",
    "kendall_relevance",
    "exponential_smoothing",
    "panel_audit",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, spark__sql__shuffle__partitions=str(cpus))
    registry = load()
    # One throwaway aggregation so that the first query does not pay for starting the JVM.
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
