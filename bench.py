"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (timed runs per query, default 3; the median counts).
Every query is run once before the timed runs, and its rows are fully produced (no-op sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tickloom.operators import costs, indicators, ledger, metrics, quality, walkforward as wf
from tickloom.plans import flagship
from tickloom.plans.fixtures import event_ticks, supp_bars
from tickloom.plans.q_eval import window_results
from tickloom.plans.q_trading import equity, known, paid
from tickloom.session import cut, local_session
from tickloom.sources.bars import ticks_to_bars


def queries(spark, sf):
    bars = cut(supp_bars(spark, sf))  # the stored bar table that the feature queries start from
    return {
        "daily_bars": lambda: supp_bars(spark, sf),
        "hourly_bars": lambda: ticks_to_bars(event_ticks(spark, sf), interval="1 hour"),
        "window_features": lambda: indicators.add_features(bars, "sma", "returns", "volatility", "donchian", "bollinger", "stoch"),
        "recursive_features": lambda: indicators.add_recursive(bars, ["ema_10", "ema_50", "rsi_14", "atr", "macd", "macd_signal"]),
        "quality_gaps_jumps": lambda: quality.price_jumps(bars, 0.5).select("symbol", "ts").union(quality.gaps(bars).select("symbol", "gap_end")),
        "equity": lambda: equity(spark, sf),
        "round_trips": lambda: ledger.round_trips(ledger.trade_list(equity(spark, sf))),
        "metrics": lambda: metrics.risk_metrics(known(spark, sf)),
        "drawdowns": lambda: metrics.drawdown_metrics(bars, value="close"),
        "cost_grid": lambda: costs.cost_grid(paid(spark, sf)),
        "walk_forward": lambda: wf.aggregate_windows(window_results(spark, sf), by=("horizon", "model")),
        "flagship": lambda: flagship.flagship_suppliers(spark, sf),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name, build in queries(spark, sf).items():
        times = []
        for _ in range(runs + 1):
            t = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        out[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
