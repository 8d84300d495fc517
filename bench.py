"""Benchmark: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is materialised with the ``noop`` sink (full execution, no output
I/O). One warm-up pass is discarded; the value per query is the median of
$BENCH_REPEAT timed runs (default 3); ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "transaction_summary",     # A-07 flagship view
    "user_summary",            # A-06
    "asset_breakdown",         # A-05
    "daily_metrics",           # A-09 (fees join + full outer + running totals)
    "volume_rollup",           # A-11
    "holdings_from_ledger",    # H-03 two-level scan
    "portfolio_summary",       # A-01 (H-03 + H-05 + join)
    "sell_gate_final",         # K-02 sorted-partition fold
    "kyc_gate",                # K-01
    "payment_reconciliation",  # R-01
    "risk_score",              # M-01..M-06
    "alert_velocity",          # M-04 range window
    "portfolio_history",       # Q-04 month spine
    "price_asof",              # Q-03
    "audit_diff",              # M-08
    "leaky_bucket",            # W-03 fold
    "live_metrics",            # W-04 batch twin
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [a for a in sys.argv[1:]] or HEADLINE
    from auric.plans.registry import load_all, run
    from auric.session import get_spark
    spark = get_spark("auric-bench", cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)))
    load_all()

    def once(n):
        t0 = time.perf_counter()
        run(n, spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    errors = {}
    for n in names:  # warm-up pass (JIT, Python workers, file listing caches)
        try:
            once(n)
        except Exception as e:  # noqa: BLE001  (report, keep benchmarking the rest)
            errors[n] = str(e).splitlines()[0][:200]
    times = {}
    for n in names:
        if n in errors:
            times[n] = None
            continue
        times[n] = round(statistics.median(once(n) for _ in range(repeat)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(t for t in times.values() if t is not None), 3), "unit": "sec",
        "queries": times, "errors": errors, "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus), "repeat": repeat, "spark": spark.version,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
