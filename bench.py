"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8), BENCH_RUNS (2).
Each query runs once to warm up; the median of the timed runs counts.
"""
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "r3_baseline_profile", "r5_residual_profile", "j12_control_sweep", "r9_review_status", "a2_overview_board",
    "a3_month_totals", "w4_worst_first", "f1_search_profile", "f1_search_quoted", "r7_update_status",
    "p11_product_tags", "p14_assemble_records", "j6_refresh_scores", "v8_direction_gate", "x6_revision_diff",
    "x8_source_audit", "t4_verify", "t4_verify_in_corpus", "t11_review_record", "d12_scan_text"]


def main():
    from pyspark.sql import SparkSession
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("advislake-bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.debug.maxToStringFields", "5")
             .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from advislake.plans import bridge, registry
    queries, _ = registry.load()
    start = time.time()
    bridge.records(spark, sf_dir)
    timings = {"release_build": round(time.time() - start, 3)}
    for name in HEADLINE:
        took = []
        for run in range(runs + 1):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        timings[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
