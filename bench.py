"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the better of two runs each, nothing cached between; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from hindsight import catalog

HEADLINE = (
    "lens_tumbling", "lens_group_by_multi", "lens_decay_exp_grouped", "replay_thinned", "curate_grouped", "curate_top_tiles",
    "tick_domain_stats", "brain_ar", "calibration_false_alarm",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, took = catalog.queries(), {}
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            spark.catalog.clearCache()
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
