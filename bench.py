"""Headline-query benchmark.

Runs the catalogue's headline queries at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": ..., "value": total_seconds, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed to completion through the no-op sink (every row is
produced, nothing is collected to the driver). Set BENCH_EVENT_LOG to a
scratch folder to record Spark's event log for tools/stage_times.py. A small warm-up run at the
smallest scale factor precedes the timings so JIT compilation is not billed
to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bootstrap_poisson",
    "split_seed_search",
    "table_one_continuous",
    "table_one_categorical",
    "rubric_grouping_sets",
    "progress_vs_base",
    "binomial_ci",
    "bootstrap_mean_ci",
    "cohort_clean",
    "quantiles",
    "multiclass_auroc",
    "aipw_stratified",
    "full_scorecard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from benchcohort.session import build_session
    from benchcohort.plans import QUERIES

    # sf0.1 is ~100 MB of input: one shuffle partition per core (~12 MB
    # each) avoids scheduling overhead; AQE coalesces further.
    extra = {"spark.driver.memory": "16g",
             # small inputs: keep AQE from folding CPU-heavy stages into a single task
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB"}
    event_dir = os.environ.get("BENCH_EVENT_LOG")  # optional: stage/task times for tools/stage_times.py
    if event_dir:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir,
                      "spark.eventLog.compress": "false"})
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra=extra)
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for name in ("binomial_ci", "table_one_continuous"):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
