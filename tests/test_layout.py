"""Plans and packing of thresholds and frequencies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import exceedance
from isotherm.sources import tables

LOAD, SEASON = [5, 6, 7, 8, 9], [6, 7, 8]


def daily(spark, kind="float", cells=5):
    days = spark.sql("select explode(filter(sequence(date'1999-04-01', date'2003-10-31'), d -> month(d) between 4 and 10)) as date")
    rows = spark.range(cells).select((F.col("id") % 2).cast("int").alias("lat_i"), F.concat(F.lit("c"), "id").alias("name")).crossJoin(days)
    v = (F.pmod(F.xxhash64("lat_i", "name", "date"), F.lit(300)) / 10).cast(kind)
    return rows.withColumn("v", F.when(F.pmod(F.xxhash64("date", "name"), F.lit(9)) > 0, v)).withColumn("name", F.when(F.col("name") != "c4", F.col("name")))


CELL = ["lat_i", "name"]
HOW = {"years": (1999, 2001), "load_months": LOAD, "season_months": SEASON}


@pytest.mark.parametrize("kind", ["float", "double", "int", "bigint", "decimal(9,1)"])
@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_one_shuffle_gives_what_two_steps_give(spark, kind, method):
    """Nulls among keys and values, several types, rows dealt at random."""
    df = daily(spark, kind).repartition(7)
    limits = exceedance.thresholds(df, CELL, "v", "date", **HOW, method=method)
    named = df.withColumn("name", F.coalesce("name", F.lit("none")))
    by_name = limits.withColumn("name", F.coalesce("name", F.lit("none")))
    for inclusive in (False, True):
        two = exceedance.frequency(named, by_name, CELL, "v", "date", SEASON, (2000, 2003), inclusive=inclusive)
        one = exceedance.heat_frequency(df, CELL, "v", "date", **HOW, freq_years=(2000, 2003), method=method, inclusive=inclusive)
        got = {(r.lat_i, r.name or "none", r.year): (r.n_days, r.n_exceed, round(r.freq, 9)) for r in one.collect()}
        assert got == {(r.lat_i, r.name, r.year): (r.n_days, r.n_exceed, round(r.freq, 9)) for r in two.collect()} and len(got) == 20


def test_thresholds_as_numpy(spark):
    df = daily(spark, "double", 2)
    got = {(r.name, r.doy): r.threshold for r in exceedance.thresholds(df, CELL, "v", "date", **HOW, method="linear").collect()}
    rows = [(r.name, r.date.timetuple().tm_yday, r.date.month, r.v) for r in df.where("year(date) <= 2001 and month(date) between 5 and 9").collect()]
    days = {d for _, d, m, _ in rows if m in SEASON}
    assert got.keys() == {(n, d) for n in ("c0", "c1") for d in days}
    for (n, d), v in got.items():
        pool = [x for name, e, _, x in rows if name == n and x is not None and min(abs(e - d), 366 - abs(e - d)) <= 7]
        assert v == pytest.approx(np.quantile(pool, 0.95))


def test_packs_of_any_size(spark, monkeypatch):
    df = daily(spark)
    whole = sorted(map(str, exceedance.thresholds(df, CELL, "v", "date", **HOW).collect()))
    monkeypatch.setattr(exceedance, "PACK", 100)
    assert whole == sorted(map(str, exceedance.thresholds(df.repartition(3), CELL, "v", "date", **HOW).collect()))
    assert exceedance.thresholds(df.limit(0), CELL, "v", "date", **HOW).count() == 0
    assert exceedance.heat_frequency(df.limit(0), CELL, "v", "date", **HOW, freq_years=(2000, 2003)).count() == 0


def test_frequency_has_one_exchange_and_no_join(spark, tmp_path):
    daily(spark).write.parquet(f"{tmp_path}/d")
    out = exceedance.heat_frequency(spark.read.parquet(f"{tmp_path}/d"), CELL, "v", "date", **HOW, freq_years=(2000, 2003))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Broadcast" not in plan
    assert plan.count("FileScan") == 1


def test_a_season_opens_its_partitions_alone(spark, tmp_path):
    days = daily(spark).select("lat_i", F.lit(0).alias("lon_i"), "date", F.col("v").alias("t2m_k"), F.year("date").alias("year"), F.month("date").alias("month"))
    tables.write_partitioned(days, f"{tmp_path}/t", ["year", "month"])
    season = tables.read_season(spark, f"{tmp_path}/t", (2000, 2001), [6, 7], box=(0, 0, 0, 0))
    assert season.count() == days.where("year between 2000 and 2001 and month in (6, 7) and lat_i = 0").count()
    files = season.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all(any(f"year={y}/month={m}/" in r.f for y in (2000, 2001) for m in (6, 7)) for r in files)
    plan = season._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "year" in filters and "month" in filters and "lat_i" in plan[plan.index("PushedFilters") :]
