"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written whole to the noop sink: one warm-up, then the median of
$BENCH_RUNS timed runs.  ``build_study`` times the shared screened panel that the
studies read; the other figures do not include it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from panelspark.plans.queries import QUERIES
from panelspark.scratch import forget_stored
from panelspark.session import local_session
from panelspark.sources.tables import stored_study

HEADLINE = ["weekly_bars", "upsert_fresh_wins", "trade_costs", "dq_summary", "split_detect", "repaired_panel", "source_compare", "screened",
            "factor_vol", "pct_rank", "top_n_signal", "base_rates", "rebalance_leaders", "equity_curve", "metrics_summary", "random_trials",
            "wf_folds", "leaderboard", "repair_report"]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    stored_study(spark, sf_dir)
    forget_stored(spark)
    times["build_study"] = round(timed(lambda: stored_study(spark, sf_dir)), 3)
    for name in names:
        run(name)
        times[name] = round(statistics.median(timed(lambda: run(name)) for _ in range(runs)), 3)
    print(json.dumps({"metric": "panel_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
