"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4),
BENCH_MEM (driver memory, default 6g), BENCH_QUERIES (comma list, optional).

Each query is fully evaluated with the ``noop`` sink (no collect to Python).
An untimed warm-up pass on sf0.001 first pays the one-off costs that do not
grow with data (JVM JIT, code generation of the rule projections, rule-plan
construction); the timed pass then measures the data work.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "lineage_positional",
    "lineage_counts",
    "lineage_by_key",
    "request_evidence",
    "upsert_lots",
    "validate_mes",
    "validate_events",
    "validate_multiformat",
    "normalise_csv",
    "normalise_json",
    "ingest_audit",
    "curate_lots",
    "reconcile",
    "access_decision",
    "trace_lots",
    "search_batch",
    "category_coverage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    mem = os.environ.get("BENCH_MEM", "6g")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from fablake.plans.catalog import QUERIES
    from fablake.session import build_session

    spark = build_session(
        master=f"local[{cpus}]",
        shuffle_partitions=max(2 * cpus, 8),
        extra={"spark.driver.memory": mem},
    )
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_s = 0.0
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        t0 = time.time()
        for n in names:
            QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
            print(f"warm {n}: {time.time() - t0:.1f}s", file=sys.stderr, flush=True)
        warm_s = time.time() - t0
        spark.catalog.clearCache()

    timings: dict[str, float] = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[n] = round(time.time() - t0, 3)
        print(f"{n}: {timings[n]}s", file=sys.stderr, flush=True)
        spark.catalog.clearCache()

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "warmup_sec": round(warm_s, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
