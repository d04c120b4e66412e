"""Seconds of each headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]: median of three runs after one to warm up."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

from quadrille import catalogue

HEADLINE = (
    "flagship_pivot", "pivot_crosstab", "agg_basic", "agg_conditional", "sumifs_cells", "stats_descriptive", "vlookup_exact", "per_row_sumifs", "match_asof", "semi_join", "sort_take",
    "filter_fn", "running_windows", "rank_eq", "math_trig", "text_battery", "date_battery", "logic_battery", "finance_battery", "distributions", "tumbling_window",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
