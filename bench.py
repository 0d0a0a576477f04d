"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalog

#: Shapes that the baseline has: instant reads, summaries, searches, jobs, trees, rollups, rates.
HEADLINE = (
    "latest_per_series", "top_by_cpu", "exits_latest", "exits_message_contains", "exits_summary_comm", "exits_summary_total", "jobs_list", "jobs_search", "trace_tree_rows", "rollup_5m_max", "counter_rate", "unit_cpu_join_exits", "sample_spacing", "thread_merge", "exit_band_join", "documents_saying",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cpus).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(sorted(runs)[1], 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total seconds of the headline queries (median of 3 runs each)", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
