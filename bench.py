"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from barloom.plans.catalog import QUERIES
from barloom.session import local_session

HEADLINE = (
    "bars_segments", "bars_brands", "flagship_strategy_performance", "perf_brands", "perf_weekly",
    "equity_features_daily", "equity_features_brands", "equity_features_blocks", "crypto_features_monthly",
    "crypto_features_weekly", "ewm_macd", "enriched_daily", "label_broadcast_daily", "label_next_4w",
    "training_window_stats", "fold_scaler", "robust_scaler", "walkforward_lr_binary", "cv_monthly_binary", "regimes_month_rows",
    "walkforward_gbt",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    QUERIES["flagship_strategy_performance"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
