"""Benchmark the headline jobs.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]``: one untimed pass over all queries, then the
median of ``$BENCH_REPEATS`` (default 3) warm runs of each.  Each run executes the whole plan
into Spark's ``noop`` sink (nothing is collected to the driver).  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ingest_diff", "token_counts", "relevance_rank", "recent_context",
    "manifest_scan", "resolve_project", "parse_extractions", "plan_requests", "handoff_export",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from briefloom.plans.queries import QUERIES
    from briefloom.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in HEADLINE:  # one untimed pass: JIT, file caches, Python workers
        run(name)
    times = {name: round(statistics.median(run(name) for _ in range(repeats)), 3) for name in HEADLINE}
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_jobs_total_median_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
