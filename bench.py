"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and
cores. Each query runs once to warm up the session's code paths (the first
query only) and is then timed once, results written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ebbtide.plans import load_all
from ebbtide.session import local_session

HEADLINE = [
    "entity_days_at_risk",
    "daily_rich",
    "sales_explorer",
    "dashboard_kpis",
    "category_day_panel",
    "region_sector_day_panel",
    "to_sales_uci",
    "insert_new",
    "quota_assign",
    "customer_mix_day",
    "set_overlap",
    "concentration",
    "rolling_days",
    "causal_percentile",
    "rank_drivers",
    "one_step_backtest",
    "adaptive_forecast_7",
    "sweep_threshold_resolution",
    "conformal_state",
    "roc_auc",
    "ingest_stream",
    "percentile_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    registry = load_all()

    def run(name: str) -> float:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])
    seconds = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
