"""Time the headline queries, or all of the library's: one JSON line with seconds per query.

Every query runs once to warm up and then ``BENCH_RUNS`` times (default 1); the median counts. Results go
to the no-op sink, so the whole plan runs and nothing is sent to the driver. ``BENCH_QUERIES=all`` takes every query,
a comma-separated list these.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = (
    "cue_normalize", "cue_groups_events", "cue_groups_merged_events", "cue_segments", "clip_catalog",
    "anchor_interval_join", "dominant_fps", "travel_day_key", "overall_priority", "day_budgets", "select_segments",
    "selection_roles", "validate_selection", "plan_faults", "timeline_items", "timeline_chunks", "edit_list", "taxonomy_correct",
    "prompt_runtime", "prompt_dates", "prompt_title", "result_upsert",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    asked = os.environ.get("BENCH_QUERIES", "")
    wanted = tuple(QUERIES) if asked == "all" else tuple(asked.split(",")) if asked else HEADLINE
    seconds = {}
    for name in wanted:
        taken = []
        for turn in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if turn:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")),
        "cores": int(cpus),
        "runs": runs,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
