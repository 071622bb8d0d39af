"""Times the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], *filter(None, [os.environ.get("PYTHONPATH")])])

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
HEADLINE = ["tss_scan_mask", "indices_all", "tsm_daily_mosaic", "nvo_fold", "stm_global_all_reducers", "stm_fold_custom_wrap", "pbc_max_ndvi", "pbc_nlcd", "pbc_bap", "tsi_2rbf", "tsi_3rbf", "tsi_wlin", "lsp_metrics", "zonal_reduce", "pivot_time_bands", "erode_dilate", "run_param_stm"]


def main() -> None:
    from pyspark.sql import SparkSession

    from pixelchron.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "5g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
