"""Seconds of the headline queries, as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from veilframe.queries import QUERIES

NAMES = ["scan_project_filter", "math_functions", "string_functions", "agg_all", "cte_nested", "join_inner", "set_union", "l2_clipped_sums", "limit_contributions", "pup_path", "dp_exact_sums", "dp_keys_mixed", "rewrite_dp_sql", "weighted_reduce", "flagship"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_project_filter"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the machinery
    times = {}
    for name in NAMES:
        begun = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begun, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
