"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from framesafe.session import local_session  # noqa: E402
from framesafe.workload import load  # noqa: E402

HEADLINE = [
    "merged_person_ranges",
    "frames_to_mask",
    "lane_segments",
    "range_overlap_score",
    "nearest_anchor",
    "lane_at_time",
    "preserved_anti",
    "box_overlap_pairs",
    "best_job",
    "hits_or",
    "search_series",
    "vector_topk",
    "identify_people",
    "cluster_people",
    "merge_actions",
    "mask_plan",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, max(8, int(cpus)), "framesafe-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # warm the JVM and the Python workers once, outside the timings
    queries["ema_lane"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf).name, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
