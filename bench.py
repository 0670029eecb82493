"""Wall seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the timed runs after
one warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_event_flow", "flt_17_groups", "flt_19_string_condition", "flt_23_route_first", "flt_26_round_robin",
    "flt_27_sample_by_key", "prj_04_remap", "prj_14_cast_null", "prj_19_step_chain", "prj_10_sha256",
    "val_04_byte_length", "val_12_all_errors", "agg_01_bucket_statistics", "agg_03_group_by", "agg_06_hourly_buckets",
    "agg_11_provider_hourly", "win_01_keep_latest", "win_02_latest_run", "win_03_upsert_conversion", "win_04_dedupe_within",
    "win_05_throttle_fixed", "cdc_05_soft_timestamp", "cdc_12_changed_fields", "jon_01_lookup", "jon_02_expand_for_each",
    "jon_05_hierarchy_depth", "set_01_union_sources", "srt_01_history", "src_09_kafka_decode", "src_21_multiline_entries",
    "snk_10_fan_out", "str_01_dedup_written_events", "str_02_stateful_upsert", "str_04_tumbling_window",
]


def main() -> None:
    from sluice.catalog import QUERIES
    from sluice.session import get_spark

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(cpus)
    spark.sparkContext.setLogLevel("OFF")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
