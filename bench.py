"""Headline timings: prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
Every query runs in full (``noop`` sink) after one warm-up query; nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "flagship", "d1_all", "slot_bars", "raw_panel_o2o", "raw_panel_de", "mad3_zscore", "manifest_projection_o2o",
    "label_o2o", "model_panel", "portfolio_grid", "daily_rank_ic", "rank_zscore_ensemble", "annual_summary",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from checks.catalog import CATALOG
    from panelwright.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["minute_bars"][0](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.time()
        CATALOG[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
