"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every query starts from the source tables: remembered runs are
dropped in between.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from haulplan.plans import queries  # noqa: E402
from haulplan.session import local_session  # noqa: E402

HEADLINE = (
    "bbox_place", "lane_route_stats", "window_groups", "lane_overlap_partners",
    "missed_singletons", "best_vehicle", "solo_manifest", "dispatch_manifest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        queries.forget()
        start = time.time()
        queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
