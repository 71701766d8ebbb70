"""Time the headline queries; prints one JSON line.

Every query counts with the median of three runs, those over REPEAT seconds with one.
BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from barwise.plans.queries import QUERIES  # noqa: E402
from barwise.session import build_session  # noqa: E402

REPEAT = 8

HEADLINE = [
    "daily_regime_stats",
    "bars_all_timeframes",
    "bar_upsert",
    "basic_features",
    "current_regimes",
    "regime_transitions",
    "regime_occupancy",
    "history_summary",
    "technical_features",
    "strategy_signals",
    "feature_signals",
    "asof_features",
    "order_levels",
    "trade_state",
    "position_book",
    "rolling_var",
    "performance_metrics",
    "correlation",
    "tactical_allocation",
    "event_versions",
    "event_state",
    "key_values",
    "risk_report",
    "walk_forward",
    "volatility_clusters",
    "stored_bars",
    "stream_daily_bars",
    "stream_indicators",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    QUERIES["daily_regime_stats"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < 3 and (not runs or runs[0] < REPEAT):
            started = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        seconds[name] = round(statistics.median(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
