"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from wavegrade.plans import catalog

HEADLINE = ("A01_window_counters", "A03_quantiles", "A06_snapshot", "J01_outcomes", "J06_phantoms", "J18_schedule_check", "A22_order_score", "W01_board_rank", "W04_effective_arrival", "C02_gaps", "M02_increase")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalog.frame(spark, sf_dir, "A28_stream_counts").collect()  # starts the executors and compiles
    for name in HEADLINE:
        began = time.time()
        catalog.frame(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
