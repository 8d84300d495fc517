"""Summarise the executed (AQE final) physical plan of every registered query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts per query: scans, shuffles (hash/range/single), broadcast exchanges,
reused exchanges, sort-merge / broadcast-hash joins, windows, window group
limits, Python nodes, and whether every filter pushed to a scan.
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def final_plan(df):
    qe = df._jdf.queryExecution()
    p = qe.executedPlan()
    try:
        return p.finalPhysicalPlan().toString()  # AdaptiveSparkPlanExec
    except Exception:  # noqa: BLE001
        return p.toString()


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from auric.plans.registry import load_all, run
    from auric.session import get_spark
    spark = get_spark("plan-report", shuffle_partitions=16)
    reg = load_all()
    print(f"# Physical plans ({os.path.basename(sf_dir)}, local[*], AQE final plans)\n")
    print("Generated by `tools/plan_report.py`. `shuffle` = hash/range exchanges, `bcast` = broadcast "
          "exchanges, `reused` = reused exchanges, `smj`/`bhj` = sort-merge/broadcast-hash joins, "
          "`win` = window operators, `wgl` = window group limits, `py` = Python nodes.\n")
    print("| query | survey | sec | scans | shuffle | bcast | reused | smj | bhj | win | wgl | py |")
    print("|---|---|---|---|---|---|---|---|---|---|---|---|")
    for name, q in sorted(reg.items(), key=lambda kv: kv[1].survey_id):
        df = run(name, spark, sf_dir)
        t0 = time.time()
        df.write.format("noop").mode("overwrite").save()
        el = time.time() - t0
        p = final_plan(df)
        c = lambda pat: len(re.findall(pat, p))
        print(f"| {name} | {q.survey_id} | {el:.1f} | {c(r'FileScan parquet')} | "
              f"{c(r'(?<!Reused)Exchange (hashpartitioning|rangepartitioning|SinglePartition)')} | "
              f"{c(r'BroadcastExchange')} | {c(r'ReusedExchange')} | {c(r'SortMergeJoin')} | "
              f"{c(r'BroadcastHashJoin')} | {c(r'\bWindow \[')} | {c(r'WindowGroupLimit')} | "
              f"{c(r'(MapInPandas|PythonMapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas)')} |")
    spark.stop()


if __name__ == "__main__":
    main()
