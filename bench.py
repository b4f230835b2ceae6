"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores.  Every query
runs once to warm up and then ``BENCH_RUNS`` times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prefilter_log", "undo_redo", "flagship_top_commands", "message_counts", "session_stats", "top_by_category",
    "collapse_runs", "time_intervals", "first_seen", "split_fixed", "translate_drop", "pair_support",
    "replace_low_level", "workflow_rows", "vocabulary", "categorify", "session_features", "mlm_targets",
    "split_random", "split_balanced", "evaluate", "score_by_vectors", "group_similarity", "pack_batches", "live_filter",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE

    from sessionloom.operators import scale
    from sessionloom.plans import registry
    from sessionloom.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    registry.load()

    def once(name: str) -> float:
        scale._hot_seen.clear()  # each run does its own hot-session check
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in names:
        once(name)
        times[name] = round(min(once(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


main()
