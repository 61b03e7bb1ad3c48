"""Wall time of headline queries; one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).  One warm-up, then the median of three.
"""

from __future__ import annotations

import json
import logging
import os
import statistics
import sys
import time
import warnings

from pyspark.sql import SparkSession

from brook import queries

HEADLINE = (
    "agg_block", "q_star_join", "q_pricing", "q_cohort", "win_per_first", "win_running", "topk_group", "join_infer", "fan_preagg", "fan_reverse", "spine_date", "spine_cross",
    "pivot_static", "dist_on", "agg_count_distinct", "sem_attr", "set_intersect", "filter_exists", "recurse", "stage_close",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.WARNING)
    warnings.simplefilter("ignore")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total median wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
