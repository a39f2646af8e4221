"""Run the headline queries and print one line of JSON with their seconds."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from seqloom.plans.registry import QUERIES

HEADLINE = (
    "match_annotate", "valid_filter", "failure_breakdown", "summary", "per_const_stats", "per_rand_stats", "rand_length_dist",
    "composition", "combinations_top20", "count_sequences", "count_table", "ranked_fasta_lines", "analysis_table", "validate_and",
    "structure_pairs", "enrichment", "analyze_end_to_end",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Code is compiled and workers are started before the clock runs.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("match_annotate", "per_const_stats", "analysis_table"):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
