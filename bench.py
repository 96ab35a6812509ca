"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is read by local[BENCH_CPUS]; each query runs once to warm up and then
BENCH_RUNS times (default 2); its time is the median.  Results go to the noop sink, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from scholia.queries import QUERIES

HEADLINE = [
    "due_first_accuracy", "overview_counts", "page_total", "keyword_search", "multi_join", "exists_count", "quota_usage", "tier_cost", "stagger_schedule", "due_order", "dup_top20", "median_mad",
    "review_replay", "review_summary", "recall_dual", "answer_cascade", "range_join", "gate_reason", "unique_select", "normalize", "cosine_topk", "sliding_rate", "job_state",
    "simhash_dups", "references_topk", "mark_clusters", "locate_questions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "16m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for k in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                took.append(time.perf_counter() - began)
        times[name] = round(median(took), 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
