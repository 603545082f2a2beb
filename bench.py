"""Headline queries, timed to full materialisation; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketloom.plans import load_all
from marketloom.plans.catalog import REGISTRY
from marketloom.session import build_session

HEADLINE = [
    "bars_time_slice", "resample_1h", "features_returns", "features_trend", "features_volatility", "features_ema_macd", "model_features", "asof_join_fundamentals",
    "dataset_alignment", "features_earnings", "quality_gate_report", "features_regime", "trading_metrics", "drift_report", "pattern_analogs", "mention_counts",
    "near_duplicate_texts", "universe_combined", "order_screen", "trade_stats",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    run = lambda n: REGISTRY[n].run(spark, sf).write.format("noop").mode("overwrite").save()
    run("trade_stats")  # start the JVM's code paths before timing
    times = {}
    for n in names:
        t = time.time()
        run(n)
        times[n] = round(time.time() - t, 3)
        print(n, times[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
