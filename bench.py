"""Benchmark the headline queries.

Runs each query to completion (noop sink: every row computed, nothing
collected) on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.plans.queries import QUERIES  # noqa: E402
from tillroll.session import local_session  # noqa: E402

HEADLINE = [
    "event_impact", "category_report", "customer_master", "date_recover", "typed_clean",
    "payment_check", "origin_price", "product_master", "traffic_mask", "sales_pipeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app_name="tillroll-bench")
    # warm-up on the smallest scale (JIT, first code generation), not timed
    QUERIES["event_impact"](spark, "/root/testdata/sf0.001").write.format("noop").mode(
        "overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
