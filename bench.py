"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

251 x 601 cells (71 % valid), and thresholds of 2,000 cells over 31 summers.  The grids are written as Parquet first, untimed.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

HEADLINES = [
    "pctl_nearest_rank", "pctl_linear", "exceed_freq_gt", "mean_freq_nan_guard", "coarsen_mean", "zonal_weighted", "annual_total_days",
    "growth_logdiff", "qcut5_dummies", "lead_join", "country_detrend", "twoway_within", "fe_ols_beta", "cluster_scores", "distance_pairs",
    "conley_meat", "ensemble_prob_floor", "pointwise_ols", "tail_slope", "smooth_kernel",
]


def grid(spark: SparkSession) -> dict[str, float]:
    from isotherm.operators import exceedance, zonal

    took, i = {}, F.col("id")
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        value = F.when(F.pmod(F.xxhash64("id"), F.lit(100)) < 71, (F.pmod(F.xxhash64(i + 1), F.lit(100_000)) / 1000).cast("float"))
        cells = spark.range(93 * 251 * 601).select((i / (251 * 601)).cast("int").alias("doy"), (400 + (i / 601) % 251).cast("int").alias("lat_i"), (550 + i % 601).cast("int").alias("lon_i"), value.alias("value"))
        cells.write.parquet(f"{folder}/cells")
        days = F.explode(F.expr("filter(sequence(date'1990-01-01', date'2020-12-31'), d -> month(d) between 5 and 9)"))
        daily = spark.range(2000).select((i / 60).cast("int").alias("lat_i"), (i % 60).cast("int").alias("lon_i"), days.alias("date"))
        daily.withColumn("t2m", (F.pmod(F.xxhash64("lat_i", "lon_i", "date"), F.lit(40_000)) / 1000).cast("float")).write.parquet(f"{folder}/daily")
        steps = {
            "coarsen_93x251x601": lambda: zonal.coarsen(spark.read.parquet(f"{folder}/cells"), "value", ["doy"]),
            "thresholds_2000_cells_31_years": lambda: exceedance.thresholds(spark.read.parquet(f"{folder}/daily"), ["lat_i", "lon_i"], "t2m", "date", (1990, 2020), [5, 6, 7, 8, 9], [6, 7, 8]),
        }
        for name, step in steps.items():
            start = time.perf_counter()
            step().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    return took


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from isotherm.plans.catalog import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "grid": grid(spark), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
