"""Summarise the executed physical plans of the headline queries.

    python scripts/plan_summary.py [sf_dir] > PLANS.md

For each query: Parquet scans, shuffle exchanges, exchanges reused, broadcast
and sort-merge joins, and whether Python runs in the plan - once with the
default broadcast threshold and once with size-based broadcasting off (what
the planner does when every table is cluster-sized; explicit, size-checked
broadcast hints still apply).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def counts(plan: str) -> dict:
    return {
        "scans": plan.count("FileScan parquet"),
        "exchanges": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        + plan.count("Exchange RoundRobinPartitioning") + plan.count("Exchange SinglePartition"),
        "reused": plan.count("ReusedExchange"),
        "broadcast joins": plan.count("BroadcastHashJoin"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "python": ("ArrowEvalPython" in plan) or ("BatchEvalPython" in plan) or ("MapInPandas" in plan),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from bench import HEADLINE
    from panelstat.plans.catalog import QUERIES
    from panelstat.session import build_session

    spark = build_session("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plan summary of the headline queries\n")
    print(f"Generated by `scripts/plan_summary.py` on `{sf_dir}` after execution (AQE final plans).\n")
    print("| Query | threshold | scans | exchanges | reused | broadcast joins | sort-merge joins | Python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name in HEADLINE + ["run_batch"]:
        for label, thr in [("default", "10485760"), ("off", "-1")]:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", thr)
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            c = counts(df._jdf.queryExecution().executedPlan().toString())
            print(f"| `{name}` | {label} | {c['scans']} | {c['exchanges']} | {c['reused']} | {c['broadcast joins']} "
                  f"| {c['sort-merge joins']} | {'yes' if c['python'] else 'no'} |")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    print("\nScans and exchanges count the final query only. Eager lineage cuts (`materialize` inside medians,")
    print("quantiles and the profile) run as their own jobs before it, and their output is read back as Parquet.")
    spark.stop()


if __name__ == "__main__":
    main()
