"""Benchmark: headline queries on the driver tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run to completion through the no-op sink (full execution,
nothing collected) ``BENCH_REPS`` times after one JVM warm-up query; the
per-query figure is the median. Prints one JSON line.
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
    "household_summary",     # flagship: A1 + F1 + A4 + A6 + A7
    "wdist_type",            # A3 top-n
    "wmedian",               # A5 range-partitioned cumulative
    "describe",              # A8 exact quantiles
    "age_bands",             # A9
    "labour_rates",          # A18 + J7
    "rates_cube",            # A20 cube
    "coded_dist_industry",   # A17
    "literacy_by_religion",  # J13 person x household join
    "lookup_district",       # J1
    "profile_urban_rural",   # A19 full profile
    "extract_records",       # R1-R13 whole texts
    "leaderboard",           # E4-E6 + A22
    "decode_stream",         # ST1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from panelstat.session import build_session
    from panelstat.plans.catalog import QUERIES

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("household_summary")  # warm-up: JVM, codegen caches, file listing
    per_query = {}
    for name in names:
        per_query[name] = round(statistics.median(run(name) for _ in range(reps)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(per_query.values()), 3), "unit": "sec",
                      "queries": per_query, "sf": float(m.group(1)) if m else None, "cpus": cpus, "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
