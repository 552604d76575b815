"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from perfcap.plans import registry
from perfcap.session import build_session

HEADLINE = [
    "f3_a8_line_findings", "f3_duration_percent_lineitem", "a1_a5_series_stats_lineitem", "a1_a5_series_stats_events",
    "a3_percentiles_hot_groups", "w4_gap_count", "w1_rolling_windows", "f5_window_predicate", "c1_l1_c13_findings",
    "n1_metrics", "s2_split_cells", "s3_timestamps", "s4_numbers", "s1_capture_samples", "s1_capture_datasets",
    "c3_j6_l3_compare", "c4_a15_l4_trends", "c5_j7_a16_l5_correlations", "c6_l6_u3_diagnostics", "c8_a18_w5_policy",
    "c9_c10_w6_alert_history", "s12_s13_upload_dedup", "j11_purged_compares",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("perfcap-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["f3_a8_line_findings"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
