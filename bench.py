"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed
runs after one warm-up (the median counts). Rows go to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gitstrata.plans import catalog
from gitstrata.session import local_session

HEADLINE = [
    "global_pattern_stats", "pattern_stats", "pattern_timeline", "pattern_trends", "top_patterns", "monthly_timeline",
    "model_performance", "top_detected", "consensus_confidence", "consensus_best",
    "commit_rollup", "classify_commits", "recent_commits", "merge_technologies",
    "simple_tags", "quality_report", "security_scan", "performance_scan", "line_patterns", "technology_evidence",
    "all_dependencies", "identify_dependencies", "architecture_style", "architecture_quality",
    "diff_snapshots", "compare_repositories", "repositories_with_stats", "moving_average", "similar_vectors",
    "insights", "heatmap", "stream_timeline", "stream_rate_limit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus)
    times = {}
    for name in names:
        measured = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured[1:]), 3)
    total = round(sum(times.values()), 3)
    scale = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
