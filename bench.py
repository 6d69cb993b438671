"""Headline queries at one scale: prints one JSON line of wall seconds.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. Each query is written to the no-op sink, so every
row and column is produced; the time is the better of two runs after one warm-up of the session.
The exact modes stand beside the plain Spark aggregate, so the price of reproducibility shows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "fld2_coarsen_area_mean", "agg1_pairwise_sum", "agg3_compensated_sum", "agg4_segmented_sum", "agg5_segmented_weighted_sum",
    "agg6_segmented_mean", "agg7_class_share", "agg9_segmented_quantile", "agg11_area_fraction_above", "agg25_region_reduction",
    "fld6_refine_extensive", "tim1_interval_mean", "jn2_interval_lookup", "agg14_monthly_accumulate", "agg20_site_statistics_sample",
    "ser3_exit_verdict", "ser5_kendall_score", "cor6_bm25_top_k", "cor8_cosine_top_k", "src5_grid_edges", "gra2_components", "gra7_drainage_terminals",
)
RUNS = 2


def main() -> None:
    from pyspark.sql import SparkSession, functions as F

    from gridspark.plans import catalogue
    from gridspark.plans.fixtures import fine_field
    from gridspark.session import prepare

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = prepare(
        SparkSession.builder.master(f"local[{cpus}]").appName("gridspark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()

    def plain_sum(s, d):
        return fine_field(s, d).agg(F.sum("l_extendedprice").alias("total"))

    work = {"plain_sum": plain_sum, **{n: queries[n] for n in HEADLINE}}
    plain_sum(spark, sf_dir).collect()
    spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).applyInPandas(lambda p: p, "id bigint").count()
    seconds = {}
    for name, fn in work.items():
        best = None
        for _ in range(RUNS):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 4)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "lineitem_rows": rows,
        "rows_per_second": {n: round(rows / s) for n, s in seconds.items() if n.startswith(("plain", "agg", "fld"))},
    }))


if __name__ == "__main__":
    main()
