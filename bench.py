"""Benchmark: run the registered queries on $BENCH_SF_DIR with
local[$BENCH_CPUS] and print one JSON line.

Each query's plan is executed completely through the ``noop`` sink (no
collection on the driver).  A query's time is building it and running it, as
some queries write files when they are built; ``value`` is the sum over the
headline set; every query of the analysis is timed and reported.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardstat.plans.queries import QUERIES  # noqa: E402
from wardstat.session import local_session  # noqa: E402

HEADLINE = [
    "provider_scorecard", "readmissions", "deaths_after_stay", "index_stays",
    "complication_stays", "code_report_all", "code_report_primary",
    "readmission_code_report", "code_frequency", "cohort_full",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if a in QUERIES]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "24")))
    # Steady state: every query runs once on the smallest tables first (JVM
    # class loading, JIT, code generation), so nothing of the timed data is
    # cached; caches are cleared again before each timed query.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    names = only or list(QUERIES)
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    build: dict[str, float] = {}
    for name in names:
        # Each query is timed without results persisted by an earlier one.
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        build[name] = round(time.perf_counter() - t0, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    head = [n for n in HEADLINE if n in times] or names
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times[n] for n in head), 3),
        "unit": "sec",
        "queries": times,
        "headline": head,
        "all_queries_total": round(sum(times.values()), 3),
        # the part of each query's time that building its plan took
        "build_sec": build,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
