"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: local cores. BENCH_QUERIES: names, or all.
Every result is computed in full and dropped. The DNS log and the parsed records are derived
once (timed as `prepare`) and shared.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from dnsloom.workload.queries import QUERIES  # noqa: E402
from dnsloom.workload.tables import Workload  # noqa: E402

HEADLINE = [
    "domain_parts",
    "entropy",
    "dns_records",
    "host_baselines",
    "subdomain_bursts",
    "nxdomain_ratios",
    "detection_signals",
    "analyze",
    "live_baseline",
    "live_burst",
    "live_detection",
    "intel_cache",
    "intel_annotated",
    "lookup_schedule",
    "alerts",
    "cef_lines",
    "csv_flat",
    "stix_bundle",
    "pcap_scan",
    "stream_detection",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dnsloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}
    start = time.perf_counter()
    workload = Workload(spark, folder)
    rows = workload.records.count()
    seconds["prepare"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](workload).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "dns_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
