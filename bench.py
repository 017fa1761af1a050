"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from parley.plans import QUERIES

HEADLINE = [
    "clean_dump", "ingest_messages", "batch_ledger", "sync_dictionary",
    "time_blocks", "block_histogram", "resolve_replies", "subcluster", "attach_short", "build_discussions",
    "render_prompts", "estimate_tokens", "pack_batches", "partition_messages",
    "participants", "nodes_discussion", "edges_interested_in", "edges_topic_cooccurs", "degrees",
    "vector_topk", "anchor_hits", "rank_candidates", "pack_context",
    "funnel", "totals", "inference_stats", "retain", "keyset_page",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "4m").config("spark.log.level", "ERROR").getOrCreate()
    )
    names = [n for n in HEADLINE if n in QUERIES and (not sys.argv[1:] or n in sys.argv[1:])]
    QUERIES["funnel"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the session
    times = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
