"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). Each query runs once to warm up, and
the better of two more runs counts, end to end: building the plan, and running it to a sink that
drops the rows.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from shiftgauge.queries import queries

HEADLINES = (
    "migration_report",
    "upgrade_report",
    "framework_coupling",
    "signature_counts",
    "database_coupling",
    "template_score",
    "framework_certainty",
    "registry_latest",
    "outdated_dependencies",
    "version_order",
    "class_split_plan",
    "rewritten_files",
    "braceless_if_census",
    "directory_rename_plan",
    "routes_dump",
    "schema_nodes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    timings = {}
    for name in HEADLINES:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(min(runs[1:]), 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
