"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Each query runs once to warm up and then BENCH_RUNS times; the median counts.
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tidemark.plans import REGISTRY
from tidemark.session import clear_scratch

QUERIES = [
    "restore_chain", "latest_image", "snapshot_manifest", "snapshot_roundtrip", "log_range", "increment_write", "table_diff",
    "verify_restore", "chain_gaps", "chain_prefix", "next_start", "asof_full", "job_baseline", "keep_newest", "retention",
    "cron_next_runs", "tree_ancestors", "metadata_objects", "normalize_sessions", "stable_tables", "increments_by_window",
    "content_hash", "typed_sort", "stream_increments", "stream_image",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or QUERIES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        # every executor of this one machine sees it; on a cluster the setting names a shared folder
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            clear_scratch(spark)
        seconds[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
