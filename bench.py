"""Times the stages and the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STAGES = ("staging", "classified_table", "locations", "amounts", "transactions", "customers_table", "base", "value_places",
          "thresholds", "c360_table", "opportunity_table", "customer_segment", "view", "sensitivity", "dq_log",
          "agg_daily_city", "agg_hour_weekday", "agg_city_summary", "agg_segment_summary", "agg_theme_segment", "kpis",
          "cube", "wide_cube")


def session(cpus: str) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallywork-bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> None:
    from tallywork.plans import catalog
    from tallywork.plans.questions import QUESTIONS

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not part of any query
    w = catalog.workspace(spark, folder)
    times: dict[str, float] = {}

    def clock(name, fn):
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)

    for stage in STAGES:
        clock(f"stage_{stage.removesuffix('_table')}", lambda: getattr(w, stage))
    for qid, (_, fn) in QUESTIONS.items():
        clock(qid.lower(), lambda: fn(w).collect())
    for name in ("k04_kmeans_fit", "n01_n06_segment_measures", "r06_cube_ratios"):
        clock(name, lambda: catalog.CATALOG[name](w).collect())
    counts = {k: df.count() for k, df in (("raw_rows", w.staging), ("clean_rows", w.fact), ("customers", w.customer_360))}
    w.close()
    print(json.dumps(counts | {"metric": "stages and questions, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
