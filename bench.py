"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the noop sink once to warm up, then timed; the median of BENCH_RUNS (3) counts.
A query that fails is named with the first line of its error under ``failed``, and the others go on. What a run
checkpoints is removed after it, so that 84 runs do not fill the disk.
"""

from __future__ import annotations

import gc
import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from panelforge.catalog import registry
from panelforge.operators.ordered import forget_sizes
from panelforge.session import build_session

HEADLINE = (
    "mean_ic", "pnl06_macro_asof", "pnl09_trim_kept", "lbl01_forward_return", "tec02_macd", "tec04_atr", "alp02_trend_quality",
    "alp06_skew_kurt", "alp14_quarters", "alp18_fast_set", "rat12_market_share", "xsf01_date_percentiles", "lag01_ticker",
    "met02_rank_ic", "qnt03_quintiles_by_date", "prt05_net_returns", "prt07_backtest", "scl01_robust_stats", "clu01_characteristics",
    "src05_chart_json", "all_features",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_RUNS", "3"))
    settings = {"spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")}
    spark = build_session("bench", f"local[{cpus}]", cpus, settings)
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}

    def once(name: str) -> float:
        forget_sizes()  # every run pays for its own size check
        scratch = tempfile.mkdtemp(prefix="bench-")  # bench runs on one machine only
        spark.sparkContext.setCheckpointDir(scratch)
        try:
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start
        finally:
            shutil.rmtree(scratch, ignore_errors=True)
            gc.collect()
            spark._jvm.System.gc()  # lets go of the shuffle files of plans no longer held

    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        try:
            once(name)
            times[name] = round(statistics.median(once(name) for _ in range(repeats)), 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"[:300]
            print(f"{name} FAILED {failed[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), **({"failed": failed} if failed else {}),
    }))


if __name__ == "__main__":
    main()
