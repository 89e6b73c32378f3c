"""Named queries over the driver's tables, one operator each, and the same in SQL.

The star schema stands in for grids and panels: nations are cells with orders
as daily values, suppliers are units with yearly means of their lines, customer
keys give places and grid indices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.config import Config
from isotherm.functions import calendar, grid, scalar
from isotherm.functions.percentile import METHODS
from isotherm.operators import econometrics, ensemble, exceedance, panel, polygons, zonal
from isotherm.plans import specs
from isotherm.sources import geometry, tables
from isotherm.sources.tiles import TileRun

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

YEARS = (1995, 1999)
LOAD, SEASON = [5, 6, 7, 8, 9], [6, 7, 8]


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def read(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{table}.parquet")
    return df.select(*columns) if columns else df


# ---- tables in the reference's shape --------------------------------------------------


def daily(spark: SparkSession, d: str) -> DataFrame:
    """cell, date, value: a nation's orders."""
    orders = read(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    customers = read(spark, d, "customer", "c_custkey", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("c_nationkey").alias("cell"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))


DAILY = "daily as (select c_nationkey as cell, cast(o_orderdate as date) as date, o_totalprice as value from orders join customer on o_custkey = c_custkey)"


def units(spark: SparkSession, d: str) -> DataFrame:
    """unit, year, country, y, x1, x2: a supplier's yearly means."""
    lines = read(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    by = lines.groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year")).agg(
        (F.avg("l_extendedprice") / 1000).alias("y"), (F.avg("l_discount") * 10).alias("x1"), (F.avg("l_quantity") / 10).alias("x2"), F.sum("l_extendedprice").alias("level")
    )
    suppliers = read(spark, d, "supplier", "s_suppkey", "s_nationkey")
    nations = read(spark, d, "nation", "n_nationkey", "n_regionkey")
    return by.join(suppliers, F.col("unit") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("unit", "year", F.col("n_regionkey").alias("country"), "y", "x1", "x2", "level")


UNITS = """units as (select l_suppkey as unit, cast(year(l_shipdate) as int) as year, any_value(n_regionkey) as country,
  avg(l_extendedprice) / 1000 as y, avg(l_discount) * 10 as x1, avg(l_quantity) / 10 as x2, sum(l_extendedprice) as level
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer", "c_custkey").select(k.alias("id"), ((k * 37) % 1801 / 10 - 90).alias("lat"), ((k * 101) % 3600 / 10 - 180).alias("lon"))


PLACES = "places as (select c_custkey as id, cast((c_custkey * 37) % 1801 as double) / 10 - 90 as lat, cast((c_custkey * 101) % 3600 as double) / 10 - 180 as lon from customer)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """lat_i, lon_i, value on a 0.1 degree grid; a value in eleven is missing."""
    k = F.col("c_custkey")
    value = F.when(k % 11 != 0, F.col("c_acctbal"))
    return read(spark, d, "customer", "c_custkey", "c_acctbal").select(k.alias("key"), (k * 13 % 60).cast("int").alias("lat_i"), (k * 17 % 3600).cast("int").alias("lon_i"), value.alias("value"))


CELLS = "cells as (select c_custkey as key, cast(c_custkey * 13 % 60 as int) as lat_i, cast(c_custkey * 17 % 3600 as int) as lon_i, case when c_custkey % 11 <> 0 then c_acctbal end as value from customer)"


# ---- scans, filters, keys -----------------------------------------------------------------


@query(f"with {PLACES} select id, lat, lon from places where lat between -30 and 45.5 and (lon >= 170 or lon <= -150)")
def scan_filter_bbox(spark, d):
    """SC1, FL1, FL2: a box across the date line."""
    return places(spark, d).where(grid.in_box("lat", "lon", -30, 45.5, 170, -150))


@query(f"""with {DAILY} select cell, cast(year(date) + (case when month(date) = 12 then 1 else 0 end) as int) as season_year,
  (case when month(date) in (12, 1, 2) then 'DJF' when month(date) in (3, 4, 5) then 'MAM' when month(date) in (6, 7, 8) then 'JJA' else 'SON' end)
  || '-' || cast(year(date) + (case when month(date) = 12 then 1 else 0 end) as varchar) as season, count(*) as n from daily group by 1, 2, 3""")
def season_year_shift(spark, d):
    """SC3, PJ15, SF1."""
    return daily(spark, d).groupBy("cell", calendar.season_year("date").alias("season_year"), calendar.season_label("date").alias("season")).agg(F.count("*").alias("n"))


@query(f"with {CELLS} select key, (lon_i + 1800) % 3600 as turned, round(-180 + lon_i * 0.1::double, 4) as lon, round(90 - lat_i * 0.1::double, 4) as lat, round((lon_i * 0.1::double + 180) - 360 * floor((lon_i * 0.1::double + 180) / 360) - 180, 4) as wrapped from cells")
def lon_wrap(spark, d):
    """PJ8, PJ9, SF12."""
    turned = grid.half_turn("lon_i", 3600)
    return cells(spark, d).select("key", turned.alias("turned"), r(grid.lon_of("lon_i", 0.1), 4).alias("lon"), r(grid.lat_of("lat_i", 0.1), 4).alias("lat"), r(grid.wrap_degrees(F.col("lon_i") * 0.1), 4).alias("wrapped"))


@query("select cast(i // 24 as int) as lat_i, cast(i % 24 as int) as lon_i, count(c_custkey) as n from range(13 * 24) t(i) left join customer on c_custkey * 13 % 13 = i // 24 and c_custkey * 17 % 24 = i % 24 group by 1, 2")
def grid_axes(spark, d):
    """SC14: every cell of a generated grid, with how many customers it has."""
    k = F.col("c_custkey")
    own = read(spark, d, "customer", "c_custkey").select((k * 13 % 13).cast("int").alias("lat_i"), (k * 17 % 24).cast("int").alias("lon_i")).groupBy("lat_i", "lon_i").agg(F.count("*").alias("n"))
    return grid.axes(spark, 13, 24).join(own, ["lat_i", "lon_i"], "left").fillna(0, ["n"])


@query(f"with {PLACES}, m as (select id, lon * 100000.0 as x, lat * 90000.0 as y, asin(lat * 90000.0 / (6378137.0 * sqrt(2))) as t from places where abs(lat * 90000.0 / (6378137.0 * sqrt(2))) <= 1) select id, round(degrees(asin((2 * t + sin(2 * t)) / pi())), 6) as lat, round(degrees(pi() * x / (2 * 6378137.0 * sqrt(2) * cos(t))), 6) as lon from m where abs(degrees(pi() * x / (2 * 6378137.0 * sqrt(2) * cos(t)))) <= 180")
def mollweide_inverse(spark, d):
    """AG28: the projection's inverse."""
    lat, lon = grid.mollweide_inverse(F.col("lon") * 100000.0, F.col("lat") * 90000.0)
    return places(spark, d).select("id", r(lat).alias("lat"), r(lon).alias("lon")).where("lat is not null and lon is not null")


@query("select l_suppkey as unit, count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1) group by 1")
def semi_filter(spark, d):
    """FL9, JN8: units that another table names."""
    nations = read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    named = read(spark, d, "supplier").join(nations, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("unit"))
    return read(spark, d, "lineitem", "l_suppkey").withColumnRenamed("l_suppkey", "unit").join(named, "unit", "left_semi").groupBy("unit").agg(F.count("*").alias("n"))


@query("with a as (select c_custkey as id, nullif(c_nationkey % 7, 0) as k from customer), b as (select n_nationkey as v, nullif(n_nationkey, 0) as k from nation) select id, a.k, v from a left join b on a.k is not distinct from b.k")
def null_safe_join(spark, d):
    """JN6, JN7 with missing keys."""
    zero = lambda c: F.when(c != 0, c)
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), zero(F.col("c_nationkey") % 7).alias("k"))
    b = read(spark, d, "nation").select(zero(F.col("n_nationkey")).alias("k"), F.col("n_nationkey").alias("v"))
    return panel.null_safe_left(a, b, ["k"])


# ---- thresholds and frequencies -----------------------------------------------------------

POOL = f"""{DAILY}, base as (select *, dayofyear(date) as doy from daily where year(date) between 1995 and 1999 and month(date) between 5 and 9),
  targets as (select distinct doy as target from base where month(date) between 6 and 8),
  pool as (select cell, target as doy, value from base join targets on least(abs(doy - target), 366 - abs(doy - target)) <= 7 where value is not null)"""
NEAREST = "list_sort(list(value))[cast(round_even(0.95 * (count(value) - 1), 0) as int) + 1]"


def limits(spark, d, method: str = "nearest") -> DataFrame:
    return exceedance.thresholds(daily(spark, d), ["cell"], "value", "date", YEARS, LOAD, SEASON, method=method)


@query(f"with {POOL} select cell, cast(doy as int) as doy, count(*) as n, round(sum(value), 2) as total from pool group by 1, 2")
def doy_window_pool(spark, d):
    """JN1, FL5, WN7: the band join as an explode."""
    base = daily(spark, d).where(F.year("date").between(*YEARS) & F.month("date").isin(LOAD)).withColumn("doy", F.dayofyear("date"))
    targets = base.where(F.month("date").isin(SEASON)).select(F.col("doy").alias("target_doy")).distinct()
    pooled = calendar.pooled_days(base, "doy").join(F.broadcast(targets), "target_doy", "left_semi")
    return pooled.groupBy("cell", F.col("target_doy").alias("doy")).agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query(f"with {POOL} select cell, cast(doy as int) as doy, {NEAREST} as threshold from pool group by 1, 2")
def pctl_nearest_rank(spark, d):
    """AG1."""
    return limits(spark, d)


@query(f"with {POOL} select cell, cast(doy as int) as doy, round(quantile_cont(value, 0.95), 4) as threshold from pool group by 1, 2")
def pctl_linear(spark, d):
    """AG2."""
    return limits(spark, d, "linear").withColumn("threshold", r("threshold", 4))


def _freq_sql(test: str) -> str:
    return f"""with {POOL}, lim as (select cell, doy, {NEAREST} as threshold from pool group by 1, 2)
  select d.cell, cast(year(date) as int) as year, count(*) as n_days, cast(sum(case when value {test} threshold then 1 else 0 end) as bigint) as n_exceed,
  round(sum(case when value {test} threshold then 1 else 0 end) / count(*), 6) as freq
  from daily d left join lim on lim.cell = d.cell and lim.doy = dayofyear(date) where month(date) between 6 and 8 and year(date) between 1996 and 2000 group by 1, 2"""


def _freq(spark, d, inclusive: bool) -> DataFrame:
    return exceedance.heat_frequency(daily(spark, d), ["cell"], "value", "date", YEARS, LOAD, SEASON, (1996, 2000), inclusive=inclusive).withColumn("freq", r("freq"))


@query(_freq_sql(">"))
def exceed_freq_gt(spark, d):
    """AG3, JN2, FL6."""
    return _freq(spark, d, False)


@query(_freq_sql(">="))
def exceed_freq_ge(spark, d):
    """The inclusive form of AG3."""
    return _freq(spark, d, True)


@query(f"select cell, case when count(freq) = 5 then round(avg(freq), 6) end as mean_freq from ({_freq_sql('>')}) where not (cell = 3 and year = 1997) group by 1")
def mean_freq_nan_guard(spark, d):
    """AG4: no mean as soon as a year is missing."""
    freq = _freq(spark, d, False).where(~((F.col("cell") == 3) & (F.col("year") == 1997)))
    return exceedance.mean_frequency(freq, ["cell"], 5).withColumn("mean_freq", r("mean_freq"))


@query(f"select printf('r%02d_c%02d', cell // 10, cell % 10 // 5) as tile, cell, year, n_days, n_exceed, freq from ({_freq_sql('>')})")
def tiled_frequency(spark, d):
    """SK6, ST3, PJ10: frequencies by tile and year, in a run that ends after one batch and another that computes the rest; then merged."""
    days, lim = daily(spark, d), limits(spark, d)
    tile = grid.tile_label((F.col("cell") / 10).cast("int"), F.col("cell") % 10, 1, 5)
    run = TileRun(spark, tables.scratch_table(spark, "tiles"))
    wanted = days.select(tile.alias("tile"), F.year("date").alias("year")).where(F.col("year").between(1996, 2000)).distinct()

    def compute(keys: DataFrame) -> DataFrame:
        own = days.withColumns({"tile": tile, "year": F.year("date")}).join(F.broadcast(keys), ["tile", "year"], "left_semi")  # at most a batch of keys
        return exceedance.frequency(own, lim, ["tile", "cell"], "value", "date", SEASON, (1996, 2000), limit_cell=["cell"])

    run.run(wanted, compute, batch_keys=10, most_batches=1)
    run.run(wanted, compute, batch_keys=10)
    return run.read("cell int, n_days long, n_exceed long, freq double").drop("place").withColumn("freq", r("freq"))


@query(f"with {DAILY}, m as (select distinct cell, year(date) as year, month(date) as month from daily where month(date) between 6 and 8 and not (year(date) = 1998 and month(date) = 7)) select cell, cast(year as int) as year, count(*) as months from m where year in (select year from m group by 1 having count(distinct month) = 3) group by 1, 2")
def complete_seasons(spark, d):
    """SC3 policy: a season without one of its months is left out."""
    from isotherm.sources.tables import complete_seasons as keep

    m = daily(spark, d).select("cell", F.year("date").alias("year"), F.month("date").alias("month")).where(F.col("month").isin(SEASON)).where("not (year = 1998 and month = 7)").distinct()
    return keep(m, SEASON, year="year").groupBy("cell", "year").agg(F.count("*").alias("months"))


# ---- grids and units ------------------------------------------------------------------------


@query(f"with {CELLS} select cast(round_even(lat_i * 0.1 / 0.25, 0) as int) as lat_i, cast(round_even(lon_i * 0.1 / 0.25, 0) as int) % 1440 as lon_i, round(cast(avg(value) as float), 2) as value from cells where value is not null group by 1, 2")
def coarsen_mean(spark, d):
    """AG7, with the circle closed."""
    return zonal.coarsen(cells(spark, d), "value").withColumn("value", r("value", 2))


ZONAL = f"{CELLS}, z as (select lat_i as unit, value, case when lon_i % 5 = 0 then 0 else lon_i % 7 end as w from cells)"


@query(f"with {ZONAL} select unit, round(sum(value * w) / sum(w), 4) as weighted, round(avg(value), 4) as plain, cast(sum(w) as double) as total_weight, cast(count(*) as int) as n_cells from z where value is not null and w > 0 group by 1")
def zonal_weighted(spark, d):
    """AG5, JN4, FL7."""
    z = cells(spark, d).withColumn("w", F.when(F.col("lon_i") % 5 == 0, 0).otherwise(F.col("lon_i") % 7))
    return zonal.weighted_zonal(z.withColumnRenamed("lat_i", "unit"), ["unit"], "value", "w").withColumns({"weighted": r("weighted", 4), "plain": r("plain", 4)})


@query(f"with {ZONAL} select unit, round(avg(value), 4) as mean, cast(count(*) as int) as n_cells from z where value is not null group by 1")
def zonal_plain(spark, d):
    """AG6."""
    return zonal.zonal(cells(spark, d).withColumnRenamed("lat_i", "unit"), ["unit"], "value").withColumn("mean", r("mean", 4))


@query(f"""with {CELLS}, z as (select lat_i as unit, value as t, case when lon_i % 4 <> 0 then lon_i / 10.0::double end as p from cells)
  select unit, round(avg(t), 4) as t, round(avg(p), 4) as p, cast(count(t) as int) as n_cells from z group by 1 having count(t) > 0""")
def zonal_two_values(spark, d):
    """AG6 of two values, each over its own valid cells."""
    z = cells(spark, d).select(F.col("lat_i").alias("unit"), F.col("value").alias("t"), F.when(F.col("lon_i") % 4 != 0, F.col("lon_i") / 10.0).alias("p"))
    return zonal.two_zonal(z, ["unit"], "t", "p").withColumns({"t": r("t", 4), "p": r("p", 4)})


@query(f"with {CELLS}, k as (select lat_i, lon_i, case when (lat_i + 2 * lon_i) % 3 = 0 then 0 else 1 end as topo from cells where lat_i < 50 group by 1, 2), s as (select lat_i, round(sum(value), 2) as total, count(*) as n from cells semi join (select * from k where topo = 1) using (lat_i, lon_i) group by 1) select * from s")
def land_mask(spark, d):
    """SC11, FL11: cells that a mask calls land; a cell outside the mask is none."""
    c = cells(spark, d)
    mask = c.where("lat_i < 50").select("lat_i", "lon_i", F.when((F.col("lat_i") + 2 * F.col("lon_i")) % 3 == 0, 0).otherwise(1).alias("topo")).distinct()
    return exceedance.on_land(c, mask, ["lat_i", "lon_i"]).groupBy("lat_i").agg(r(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query(f"with {CELLS} select lat_i, lon_i, count(value) as n_valid from cells group by 1, 2 having count(value) > 0")
def valid_cells(spark, d):
    """AG27, FL17, FL3: cells with any value, and how many."""
    return exceedance.valid_cells(cells(spark, d), ["lat_i", "lon_i"], "value")


@query(f"with {DAILY}, t as (select cast(cell as int) as lat_i, date, cast(value as float) as v, year(date) as y, month(date) as m from daily where cell between 3 and 15) select lat_i, cast(y + (case when m >= 11 then 1 else 0 end) as int) as season_year, count(*) as n, round(sum(v::double), 0) as total from t where m in (11, 12, 1, 2) and y + (case when m >= 11 then 1 else 0 end) between 1996 and 1998 group by 1, 2")
def partitioned_scan(spark, d):
    """SC1 to SC3, SK1: daily cells written by year and month, and a season of some years and rows read back; other months are never opened."""
    path = tables.scratch_table(spark, "tmax_daily")
    long = daily(spark, d).select(F.col("cell").cast("int").alias("lat_i"), F.lit(0).alias("lon_i"), "date", F.col("value").cast("float").alias("t2m_k"), F.year("date").alias("year"), F.month("date").alias("month"))
    tables.write_partitioned(long, path, ["year", "month"])
    season = tables.read_season(spark, path, (1996, 1998), [11, 12, 1, 2], box=(3, 15, 0, 0))
    return season.groupBy("lat_i", "season_year").agg(F.count("*").alias("n"), r(F.sum("t2m_k"), 0).alias("total"))


@query("select cast(case when y <= 2002 then 2000 when y <= 2007 then 2005 when y <= 2012 then 2010 when y <= 2017 then 2015 when y <= 2022 then 2020 else 2025 end as int) as epoch, count(*) as n, round(sum(o_totalprice), 2) as total from (select year(o_orderdate) + 4 * (o_custkey % 7) as y, o_totalprice from orders) group by 1")
def epoch_map(spark, d):
    """JN5: values of years spread over 1995 to 2025, by settlement epoch."""
    y = F.year("o_orderdate") + 4 * (F.col("o_custkey") % 7)
    return read(spark, d, "orders", "o_orderdate", "o_custkey", "o_totalprice").groupBy(zonal.epoch_of(y).alias("epoch")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


MONTHLY = f"{DAILY}, monthly as (select cell, cast(year(date) as int) as year, cast(month(date) as int) as month, case when (cell + month(date)) % 23 <> 0 then avg(value) / 100000 end as rate from daily group by cell, year(date), month(date))"


def monthly(spark, d) -> DataFrame:
    m = daily(spark, d).groupBy("cell", F.year("date").alias("year"), F.month("date").alias("month")).agg((F.avg("value") / 100000).alias("rate"))
    return m.withColumn("rate", F.when((F.col("cell") + F.col("month")) % 23 != 0, F.col("rate")))


@query(f"with {MONTHLY} select cell, year, case when count(rate) = 12 then round(sum(rate * day(last_day(make_date(year, month, 1)))) * 1000, 4) end as total from monthly group by 1, 2")
def annual_total_days(spark, d):
    """AG9, SF2, PJ1."""
    return zonal.annual_total(monthly(spark, d), ["cell"], "rate").withColumn("total", r("total", 4))


@query(f"with {MONTHLY} select cell, year, round(avg(rate), 6) as rate from monthly group by 1, 2")
def annual_mean_months(spark, d):
    """AG8."""
    return zonal.annual_mean(monthly(spark, d), ["cell"], "rate").withColumn("rate", r("rate"))


@query("select cast(c_custkey * 13 % 60 as int) as lat_i, cast(c_custkey * 17 % 90 as int) as lon_i, max(c_custkey) as raster_id from customer group by 1, 2")
def last_wins_mosaic(spark, d):
    """ST3, JN17: of overlapping writes the last."""
    k = F.col("c_custkey")
    return zonal.last_wins(read(spark, d, "customer").select((k * 13 % 60).cast("int").alias("lat_i"), (k * 17 % 90).cast("int").alias("lon_i"), k.alias("raster_id")), ["lat_i", "lon_i"], "raster_id")


def rectangle(west: Column, south: Column, east: Column, north: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))


def supplier_polygons(spark, d) -> DataFrame:
    """id and polygons of suppliers: rectangles, some with a hole, some in two parts, in degrees."""
    k = F.col("s_suppkey")
    w, s = (k * 31 % 340 - 170).cast("double"), (k * 17 % 160 - 80).cast("double")
    own = rectangle(w + 0.2, s + 0.2, w + 3.7, s + 2.6)
    hole = F.when(k % 3 == 1, F.array(own, rectangle(w + 1, s + 1, w + 2, s + 2))).otherwise(F.array(own))
    parts = F.when(k % 3 == 0, F.array(hole, F.array(rectangle(w + 5.2, s + 0.2, w + 8.7, s + 2.6)))).otherwise(F.array(hole))
    return read(spark, d, "supplier").select(k.alias("id"), parts.alias("polygons"))


CENTRES = """centres as (select s_suppkey as id, case s_suppkey % 3 when 0 then w + 4.45 when 1 then (8.4 * (w + 1.95) - (w + 1.5)) / 7.4 else w + 1.95 end as lon,
  case s_suppkey % 3 when 1 then (8.4 * (s + 1.4) - (s + 1.5)) / 7.4 else s + 1.4 end as lat
  from (select s_suppkey, cast(s_suppkey * 31 % 340 - 170 as double) as w, cast(s_suppkey * 17 % 160 - 80 as double) as s from supplier))"""


@query("""with u as (select s_suppkey as id, cast(s_suppkey * 31 % 340 - 170 as double) as w, cast(s_suppkey * 17 % 160 - 80 as double) as s from supplier)
  select cast(r as int) as lat_i, cast(c as int) as lon_i, max(id) as raster_id from u, range(360) tc(c), range(181) tr(r)
  where 89.5 - r <= s + 2.6 and 90.5 - r >= s + 0.2 and ((c - 180.5 <= w + 3.7 and c - 179.5 >= w + 0.2) or (id % 3 = 0 and c - 180.5 <= w + 8.7 and c - 179.5 >= w + 5.2)) group by 1, 2""")
def burn_units(spark, d):
    """JN17: polygons of suppliers onto a one degree grid; their holes are smaller than a cell."""
    u = supplier_polygons(spark, d).select(F.col("id").alias("raster_id"), F.flatten("polygons").alias("rings"))
    return polygons.burn(u, step=1.0)


@query("""with u as (select s_suppkey as id, 172.31 + s_suppkey % 5 as w, cast(s_suppkey * 17 % 150 - 80 as double) + 0.23 as s from supplier)
  select cast(r as int) as lat_i, cast(c % 360 as int) as lon_i, max(id) as raster_id from u, range(340, 380) tc(c), range(181) tr(r)
  where c - 180.5 <= w + 9.6 and c - 179.5 >= w and 89.5 - r <= s + 7.4 and 90.5 - r >= s
    and not (c - 180.5 > w + 2.4 and c - 179.5 < w + 7.2 and 89.5 - r > s + 1.1 and 90.5 - r < s + 6.3) group by 1, 2""")
def burn_date_line(spark, d):
    """JN17: rectangles with holes over the date line, through binary geometry of both byte orders."""
    k = F.col("s_suppkey")
    w, s = F.lit(172.31) + k % 5, (k * 17 % 150 - 80).cast("double") + 0.23
    turned = lambda ring: F.transform(ring, lambda p: F.struct(F.when(p["lon"] > 180, p["lon"] - 360).otherwise(p["lon"]).alias("lon"), p["lat"].alias("lat")))
    one = F.array(F.array(turned(rectangle(w, s, w + 9.6, s + 7.4)), turned(rectangle(w + 2.4, s + 1.1, w + 7.2, s + 6.3))))
    u = read(spark, d, "supplier").select(k.alias("raster_id"), one.alias("polygons"))
    held = u.select("raster_id", F.when(F.col("raster_id") % 2 == 0, geometry.binary_of("polygons")).otherwise(geometry.binary_of("polygons", big_endian=True)).alias("geometry"))
    return polygons.burn(held.select("raster_id", F.flatten(geometry.polygons_of("geometry")).alias("rings")), step=1.0)


@query(f"with {CENTRES} select id, round(lon, 6) as lon, round(lat, 6) as lat from centres")
def ring_centroid(spark, d):
    """SF10, EC2: centroids of polygons with parts and holes."""
    lon, lat = polygons.centroid(F.col("polygons"))
    return supplier_polygons(spark, d).select("id", r(lon).alias("lon"), r(lat).alias("lat"))


@query(f"""with {UNITS}, {CENTRES} select unit, year, round(x1, 6) as x1, round(lon, 6) as lon, round(lat, 6) as lat, cast(case when id is null then null when id % 3 = 2 then 5 else 10 end as int) as n_points
  from units left join (select * from centres where id % 7 <> 0) on id = unit""")
def panel_geometry(spark, d):
    """JN8, SC6, SK4: a panel with the geometry of its units, written as binary, read back without the columns not needed; units without a geometry stay."""
    path = tables.scratch_table(spark, "units")
    tables.write_vectors(supplier_polygons(spark, d).where("id % 7 <> 0").select(F.col("id").alias("unit"), F.lit("x").alias("name"), "polygons"), path)
    shapes = tables.read_vectors(spark, path, ignore=["name"])
    lon, lat = polygons.centroid(F.col("polygons"))
    n = F.aggregate(F.flatten("polygons"), F.lit(0), lambda a, ring: a + F.size(ring))
    placed = shapes.select("unit", r(lon).alias("lon"), r(lat).alias("lat"), n.alias("n_points"))
    return units(spark, d).select("unit", "year", r("x1").alias("x1")).join(placed, "unit", "left")


@query("""with p as (select c_custkey % 3000 * 4000.0::double - 6e6 as x, c_custkey * 7 % 1500 * 8000.0::double - 6e6 as y, c_acctbal as v from customer),
  m as (select x, v, asin(y / (6378137.0 * sqrt(2))) as t from p where abs(y / (6378137.0 * sqrt(2))) <= 1),
  g as (select degrees(asin((2 * t + sin(2 * t)) / pi())) as lat, degrees(pi() * x / (2 * 6378137.0 * sqrt(2) * cos(t))) as lon, v from m)
  select cast(round_even(90 - lat, 0) as int) as lat_i, cast(round_even(lon + 180, 0) as int) % 360 as lon_i, 2000 as epoch, round(cast(avg(v) as float), 1) as built_surface from g where abs(lon) <= 180 group by 1, 2""")
def reproject_built(spark, d):
    """AG28: Mollweide pixels to cells and epochs."""
    k = F.col("c_custkey")
    points = read(spark, d, "customer").select((k % 3000 * 4000.0 - 6e6).alias("x"), (k * 7 % 1500 * 8000.0 - 6e6).alias("y"), F.lit(2000).alias("epoch"), F.col("c_acctbal").alias("value"))
    return zonal.reproject_built(points, step=1.0).withColumn("built_surface", r("built_surface", 1))


# ---- panels ------------------------------------------------------------------------------------


@query(f"with {UNITS} select unit, year, round(x1, 6) as value from units where year between 1995 and 2000")
def unpivot_long(spark, d):
    """PJ7: wide years to rows."""
    years = list(range(1995, 2001))
    wide = units(spark, d).groupBy("unit").pivot("year", years).agg(F.first("x1"))
    return panel.melt_years(wide, ["unit"]).where("value is not null").withColumn("value", r("value"))


@query(f"with {UNITS} select unit, year, round(ln(level) - ln(lag(level) over (partition by unit order by year)), 6) as growth from units")
def growth_logdiff(spark, d):
    """WN1."""
    return panel.log_growth(units(spark, d), "unit", "year", "level").select("unit", "year", r("growth").alias("growth"))


@query(f"with {UNITS} select unit, year, round(y - avg(y) over (partition by country, year), 6) as residual from units")
def group_demean(spark, d):
    """WN2, AG14."""
    return panel.demean(units(spark, d), "y", ["country", "year"], "residual").select("unit", "year", r("residual").alias("residual"))


@query(f"""with {UNITS}, m as (select unit, median(level) as v from units group by 1), e as (select quantile_cont(v, 1 / 3) as a, quantile_cont(v, 2 / 3) as b from m)
  select unit, case when v > b then 'high' when v > a then 'mid' else 'low' end as tercile from m, e""")
def median_tercile(spark, d):
    """AG10, AG11, JN12."""
    return panel.terciles(units(spark, d), "unit", "level").select("unit", "tercile").distinct()


@query(f"""with {UNITS}, e as (select quantile_cont(x2, [0.2, 0.4, 0.6, 0.8]) as q from units),
  b as (select unit, year, cast(1 + (case when x2 > q[1] then 1 else 0 end) + (case when x2 > q[2] then 1 else 0 end) + (case when x2 > q[3] then 1 else 0 end) + (case when x2 > q[4] then 1 else 0 end) as int) as bin from units, e)
  select unit, year, bin, cast(bin = 2 as double) as bin_2, cast(bin = 3 as double) as bin_3, cast(bin = 4 as double) as bin_4, cast(bin = 5 as double) as bin_5 from b""")
def qcut5_dummies(spark, d):
    """AG11, PJ6."""
    cut = panel.qcut(units(spark, d).select("unit", "year", "x2"), "x2", 5, "bin", duplicates="drop")
    return panel.dummies(cut, "bin", [2, 3, 4, 5], "bin_").drop("x2")


@query(f"with {UNITS} select h.unit, h.year as year_heat, g.year as year_gdp, round(h.x1, 6) as x1, round(g.y, 6) as y from units h join units g on g.unit = h.unit and g.year = h.year + 1 where g.year <> 1998")
def lead_join(spark, d):
    """JN11, PJ4: years may be missing."""
    u = units(spark, d)
    heat = u.select("unit", F.col("year").alias("year_heat"), r("x1").alias("x1"))
    growth = u.select("unit", F.col("year").alias("year_gdp"), r("y").alias("y")).where("year_gdp <> 1998")
    return panel.lead_join(heat, growth, "unit")


@query(f"with {UNITS}, l as (select 'x1' as variable, x1 as v from units union all select 'y', y from units) select variable, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max, count(v) as n from l group by 1")
def summary_stats(spark, d):
    """AG13."""
    s = panel.summary(units(spark, d), ["x1", "y"])
    return s.withColumns({c: r(c) for c in ("mean", "std", "min", "max")})


@query("select l_orderkey, l_linenumber, l_discount, case when l_discount < 0.001 then '***' when l_discount < 0.01 then '**' when l_discount < 0.05 then '*' when l_discount < 0.1 then '+' else '' end as stars from lineitem")
def stars(spark, d):
    """SF14."""
    return read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount").withColumn("stars", scalar.stars("l_discount"))


def tail_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t with whole degrees of freedom, by the finite series in the angle."""
    a = f"atan(abs({t}) / sqrt({df}))"
    odd = f"2 / pi() * ({a} + sin({a}) * coalesce(list_sum(list_transform(range(0, cast(({df} - 1) // 2 as bigint)), lambda j: exp(2 * j * ln(2.0) + 2 * lgamma(j + 1.0) - lgamma(2.0 * j + 2)) * cos({a}) ** (2 * j + 1))), 0))"
    even = f"sin({a}) * list_sum(list_transform(range(0, cast({df} // 2 as bigint)), lambda j: exp(lgamma(2.0 * j + 1) - 2 * j * ln(2.0) - 2 * lgamma(j + 1.0)) * cos({a}) ** (2 * j)))"
    return f"(1 - case when {df} % 2 = 1 then {odd} else {even} end)"


# ---- regression ------------------------------------------------------------------------------------

TREND = f"""{UNITS}, c as (select unit, year, country, y, year - avg(year) over (partition by country) as x from units),
  m as (select country, count(*) as n, sum(x*x) as s2, sum(x*x*x) as s3, sum(x*x*x*x) as s4, sum(y) as b0, sum(x*y) as b1, sum(x*x*y) as b2 from c group by 1),
  k as (select *, (b2 - s2*b0/n - s3*b1/s2) / (s4 - s2*s2/n - s3*s3/s2) as c2 from m), q as (select country, c2, (b1 - s3*c2) / s2 as c1, (b0 - s2*c2) / n as c0 from k)"""


@query(f"with {TREND} select unit, year, round(y - c0 - c1*x - c2*x*x, 5) as y from c join q using (country)")
def country_detrend(spark, d):
    """WN3."""
    return econometrics.detrend_quadratic(units(spark, d), ["y"], "country", "year").select("unit", "year", r("y", 5).alias("y"))


# every supplier has lines in every year, where the short form of the two-way transform is exact
WITHIN = f"{UNITS}, w as (select unit, year, y - avg(y) over (partition by unit) - avg(y) over (partition by year) + avg(y) over () as y, x1 - avg(x1) over (partition by unit) - avg(x1) over (partition by year) + avg(x1) over () as x1 from units)"


def within(spark, d, panel_: DataFrame | None = None) -> DataFrame:
    u = units(spark, d) if panel_ is None else panel_
    return econometrics.within_two_ways(u.select("unit", "year", "y", "x1"), ["y", "x1"], "unit", "year")


def standard_error(v) -> float:
    return round(float(max(v[0, 0], 0.0)) ** 0.5, 6)


def fitted(panel_: DataFrame, rows: Callable[[econometrics.Fit], list[tuple]], schema: str) -> DataFrame:
    """Rows made of a fit of y on x1; the transformed panel is held while its sums are taken, and no longer."""
    held = panel_.persist()
    try:
        return panel_.sparkSession.createDataFrame(rows(econometrics.Fit(held, "y", ["x1"], "unit", "year")), schema)
    finally:
        held.unpersist()


@query(f"with {WITHIN} select unit, year, round(y, 6) as y, round(x1, 6) as x1 from w")
def twoway_within(spark, d):
    """WN4."""
    return within(spark, d).select("unit", "year", r("y").alias("y"), r("x1").alias("x1"))


@query(f"with {WITHIN}, b as (select sum(x1*y) / sum(x1*x1) as beta, count(*) as n from w) select round(beta, 6) as beta, n, round((select sum((y - beta*x1) * (y - beta*x1)) from w), 4) as rss from b")
def fe_ols_beta(spark, d):
    """EC3, AG17, AG18."""
    return fitted(within(spark, d), lambda fit: [(round(float(fit.beta[0]), 6), fit.n, round(fit.rss, 4))], "beta double, n long, rss double")


@query(f"""with {WITHIN}, b as (select sum(x1*y) / sum(x1*x1) as beta, sum(x1*x1) as xx, count(*) as n, count(distinct unit) as u, count(distinct year) as t from w),
  s as (select unit, year, x1 * (y - beta*x1) as s from w, b), mu as (select sum(t*t) as m from (select sum(s) as t from s group by unit)), mt as (select sum(t*t) as m from (select sum(s) as t from s group by year)), mr as (select sum(s*s) as m from s)
  select 'time' as kind, round(sqrt(mt.m) / xx * sqrt(n / (n - 1 - u - t + 1)), 6) as se from b, mt union all
  select 'unit', round(sqrt(mu.m) / xx * sqrt(n / (n - 1 - u - t + 1)), 6) from b, mu union all
  select 'two_way', round(sqrt(greatest(mu.m + mt.m - mr.m, 0)) / xx * sqrt(n / (n - 1 - u - t + 1)), 6) from b, mu, mt, mr""")
def cluster_scores(spark, d):
    """AG16, EC4."""
    return fitted(within(spark, d), lambda fit: [(k, standard_error(fit.covariance(k))) for k in ("time", "unit", "two_way")], "kind string, se double")


XYZ = f"{PLACES}, p as (select id, cos(radians(lat)) * cos(radians(lon)) as x, cos(radians(lat)) * sin(radians(lon)) as y, sin(radians(lat)) as z from places)"
KM = "2 * 6371.0 * asin(least(1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2))"


@query(f"with {XYZ} select a.id as i, b.id as j, round({KM}, 3) as km, round(greatest(0, 1 - {KM} / 500), 5) as w from p a join p b on a.id < b.id and abs(a.z - b.z) < 0.08 where {KM} <= 500")
def distance_pairs(spark, d):
    """JN14, SF6 to SF9."""
    pairs = econometrics.distance_pairs(places(spark, d), 500.0).where("i <> j")
    return pairs.select("i", "j", r("km", 3).alias("km"), r(scalar.bartlett("km", 500.0), 5).alias("w"))


@query(f"""with {WITHIN}, {XYZ}, e as (select unit, sum(x1 * (y - (select sum(x1*y) / sum(x1*x1) from w) * x1)) as s from w group by 1),
  pr as (select a.id as i, b.id as j, greatest(0, 1 - {KM} / 1000) as k from p a join p b on a.id < b.id where {KM} <= 1000 and a.id in (select unit from e) and b.id in (select unit from e)), n as (select count(*) as n from e)
  select round(sqrt(greatest(((select sum(s*s) from e) + coalesce((select 2 * sum(k * x.s * y.s) from pr join e x on x.unit = i join e y on y.unit = j), 0)) * n / (n - 1), 0)) / (select sum(x1*x1) from w), 6) as se, n as n_placed from n""")
def conley_meat(spark, d):
    """EC7: spatial standard error at 1000 km."""
    own = places(spark, d).join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi")

    def rows(fit: econometrics.Fit) -> list[tuple]:
        v, n = fit.conley(own, [1000.0], key="id")[1000.0]
        return [(standard_error(v), n)]

    return fitted(within(spark, d), rows, "se double, n_placed long")


def _spline_sql() -> str:
    """The natural cubic spline through four knots, its second derivatives by Cramer's rule."""
    d1, d2 = ("1 / h0", "-1 / h0 - 1 / h1", "1 / h1", "0"), ("0", "1 / h1", "-1 / h1 - 1 / h2", "1 / h2")
    second = ", ".join(f"((h1 + h2) / 3 * ({d1[i]}) - h1 / 6 * ({d2[i]})) / det as m1{i}, ((h0 + h1) / 3 * ({d2[i]}) - h1 / 6 * ({d1[i]})) / det as m2{i}" for i in range(4))
    m = lambda j, i: f"m{j}{i}" if j in (1, 2) else "0"
    bend = lambda j, i, side, at: f"{m(at, i)} * h{j} * h{j} / 6 * ({side}{j} * {side}{j} * {side}{j} - {side}{j})"
    piece = lambda i, j: f"{int(i == j)} * l{j} + {int(i == j + 1)} * r{j} + {bend(j, i, 'l', j)} + {bend(j, i, 'r', j + 1)}"
    columns = ", ".join(f"round(case when x2 <= k[2] then {piece(i, 0)} when x2 <= k[3] then {piece(i, 1)} else {piece(i, 2)} end, 8) as s{i + 1}" for i in range(4))
    sides = ", ".join(f"(k[{j + 2}] - x2) / h{j} as l{j}, (x2 - k[{j + 1}]) / h{j} as r{j}" for j in range(3))
    return f"""with {UNITS}, q as (select quantile_cont(x2, [0, 1 / 3, 2 / 3, 1]) as k from (select distinct x2 from units)),
      h as (select k, k[2] - k[1] as h0, k[3] - k[2] as h1, k[4] - k[3] as h2 from q), a as (select *, (h0 + h1) * (h1 + h2) / 9 - h1 * h1 / 36 as det from h),
      b as (select *, {second} from a), p as (select unit, year, x2, b.*, {sides} from units, b) select unit, year, {columns} from p"""


@query(_spline_sql())
def spline_basis(spark, d):
    """WN9: the basis at every observation; rows add up to 1."""
    u = units(spark, d)
    knots = econometrics.spline_knots(u, "x2")
    return u.select("unit", "year", *[r(c, 8).alias(f"s{i + 1}") for i, c in enumerate(econometrics.spline_basis(F.col("x2"), knots))])


def study(spark, d) -> specs.Study:
    u = units(spark, d).withColumn("residual", F.col("y") - F.col("x2"))
    table = panel.terciles(u, "unit", "level", "income_tercile").select("unit", "year", "country", F.col("y").alias("growth"), "x1", "x2", "residual", "income_tercile")
    own = places(spark, d).join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi").withColumnRenamed("id", "unit")
    out = specs.Study(table, own, y="growth", heat="x1", unit="unit", year="year", country="country")
    out.panel, out.places = out.hold(table), out.hold(own)
    return out


CONTROL_SETS = {"bare": [], "full": ["x2"]}


@query()
def regression_table(spark, d):
    """EC8 to EC14, EC16, PJ11, AG23 to AG25, ST5, PJ5, FL10, FL16: both control sets, every specification and the lags, as one tidy table."""
    u = units(spark, d)
    heat = u.select("unit", "year", "country", "x1", "x2")
    return specs.regression_table(study(spark, d), CONTROL_SETS, heat=heat, growth=u.select("unit", F.col("year").alias("year_gdp"), F.col("y").alias("growth")))


# Regressions in SQL.  Trends per country, two-way effects (balanced panels), one control projected out, then
# one regressor: its standard errors are plain sums.


def _fit_sql(n: str, source: str, y: str, x: str, controls: list[str]) -> str:
    """CTEs ``n_p`` (unit, year, y, x) without trends, effects and controls, and ``n_b`` (beta and counts).

    Controls are projected out of one another and of the rest, one at a time.
    """
    cols = list(dict.fromkeys([y, x, *controls]))
    moments = ", ".join(f"sum({c}) as b0{c}, sum(t*{c}) as b1{c}, sum(t*t*{c}) as b2{c}" for c in cols)
    curves = ", ".join(f"(b2{c} - s2*b0{c}/n - s3*b1{c}/s2) / (s4 - s2*s2/n - s3*s3/s2) as q{c}" for c in cols)
    rest = ", ".join(f"{c} - (b0{c} - s2*q{c})/n - (b1{c} - s3*q{c})/s2*t - q{c}*t*t as {c}" for c in cols)
    effects = ", ".join(f"{c} - avg({c}) over (partition by unit) - avg({c}) over (partition by year) + avg({c}) over () as {c}" for c in cols)
    steps, last = "", f"{n}_w"
    for i, c in enumerate(controls):
        others = [o for o in cols if o not in controls[: i + 1]]
        out = ", ".join(f"{o} - {c} * (select sum({o}*{c}) / sum({c}*{c}) from {last}) as {o}" for o in others)
        steps += f", {n}_w{i} as (select unit, year, whole, {out} from {last})"
        last = f"{n}_w{i}"
    return f"""{n}_c as (select *, year - avg(year) over (partition by country) as t from {source}),
      {n}_m as (select country, count(*) as n, sum(t*t) as s2, sum(t*t*t) as s3, sum(t*t*t*t) as s4, {moments} from {n}_c group by 1),
      {n}_k as (select *, {curves} from {n}_m), {n}_d as (select unit, year, {rest} from {n}_c join {n}_k using (country)), {n}_w as (select *, {y} as whole from (select unit, year, {effects} from {n}_d)){steps},
      {n}_p as (select unit, year, {y} as y, {x} as x, whole from {last}),
      {n}_e as (select unit, year, x, y - x * (select sum(x*y) / sum(x*x) from {n}_p) as e, whole from {n}_p),
      {n}_b as (select (select sum(x*y) / sum(x*x) from {n}_p) as beta, sum(x*x) as xx, 1 - sum(e*e) / sum(whole*whole) as r2, count(*) as n, count(distinct unit) as u, count(distinct year) as ys, {1 + len(controls)} as k from {n}_e),
      {n}_u as (select unit, sum(x*e) as s from {n}_e group by 1), {n}_t as (select sum(x*e) as s, row_number() over (order by year) as i from {n}_e group by year)"""


_PAIRS = f"pairs as (select a.id as i, b.id as j, {KM} as km from p a join p b on a.id < b.id where {KM} <= 1000)"


def _rows_sql(n: str, spec: str, depvar: str, variable: str, kinds: list[str]) -> str:
    meats = {
        "clustered_entity": f"(select sum(s*s) from {n}_u)", "clustered_time": f"(select sum(s*s) from {n}_t)",
        "driscoll_kraay": f"((select sum(s*s) from {n}_t) + 2 * (select coalesce(sum((1 - (b.i - a.i) / 6) * a.s * b.s), 0) from {n}_t a join {n}_t b on b.i - a.i between 1 and 5))",
    }
    meats["clustered_two_way"] = f"({meats['clustered_entity']} + {meats['clustered_time']} - (select sum(x*e*x*e) from {n}_e))"
    out = []
    for kind in kinds:
        if kind.startswith("conley"):
            cut = float(kind.split("_")[1])
            var = f"({meats['clustered_entity']} + 2 * coalesce((select sum((1 - km / {cut}) * a.s * b.s) from pairs join {n}_u a on a.unit = i join {n}_u b on b.unit = j where km <= {cut}), 0)) * u / (u - 1)"
            df = "(n - u - k)"
        else:
            var, df = f"{meats[kind]} * n / (n - k - u - ys + 1)", "(n - k - u - ys + 1)"
        out.append(f"select '{spec}' as spec, '{depvar}' as depvar, '{variable}' as variable, '{kind}' as se_type, beta, sqrt({var}) / xx as se, r2, n, u, {df} as df from {n}_b")
    return " union all ".join(out)


def _tidy_sql(rows: str) -> str:
    return f"select spec, depvar, variable, se_type, round(beta, 6) as beta, round(se, 6) as se, round(beta / se, 4) as tstat, round({tail_sql('beta / se', 'df')}, 6) as pval, round(r2, 6) as r2_within, cast(n as int) as n_obs, cast(u as int) as n_entities from ({rows})"


def _tidy(results: DataFrame) -> DataFrame:
    return results.withColumns({"beta": r("beta"), "se": r("se"), "tstat": r("tstat", 4), "pval": r("pval"), "r2_within": r("r2_within")})


_SETS = [("bare", []), ("full", ["x2"])]
_MAIN = ", ".join(_fit_sql(f"{name}_{y}", "st", y, "x1", c) for name, c in _SETS for y in ("growth", "residual"))
_ALL_KINDS = ["clustered_entity", "clustered_time", "clustered_two_way", "driscoll_kraay", "conley_250", "conley_500", "conley_1000"]
_MAIN_ROWS = " union all ".join(
    _rows_sql(f"{name}_{y}", f"{name}_{spec}", y, "x1", kinds) for name, _ in _SETS for spec, y, kinds in (("baseline", "growth", ["clustered_entity", "conley_500"]), ("se_comparison", "growth", _ALL_KINDS), ("residual_dv", "residual", ["clustered_entity", "conley_500"]))
)


@query(f"with {UNITS}, {XYZ}, {_PAIRS}, st as (select unit, year, country, y as growth, x1, x2, y - x2 as residual from units), {_MAIN} {_tidy_sql(_MAIN_ROWS)}")
def regression_main(spark, d):
    """EC4, EC5, EC7 to EC9, EC13, EC16: baseline, seven standard errors and the other outcome, under both control sets."""
    chosen = [specs.baseline, specs.standard_errors, specs.residual_outcome]
    return _tidy(specs.regression_table(study(spark, d), CONTROL_SETS, chosen))


# terciles of so few units as the tables have: in the small ones each part has fewer rows than a study would ask for
def terciles_of_any_size(s: specs.Study) -> list[specs.Row]:
    return specs.by_income(s, least_rows=60, least_units=8)


_TWO = ["clustered_entity", "conley_500"]
_DUMMIES = [f"d{k}" for k in range(2, 6)]
_SHAPES, _SHAPE_ROWS = [], []
for _name, _controls in _SETS:
    for _x, _other in (("x1", "sq"), ("sq", "x1")):
        _SHAPES.append(_fit_sql(f"{_name}_q{_x}", "st", "growth", _x, [_other, *_controls]))
        _SHAPE_ROWS.append(_rows_sql(f"{_name}_q{_x}", f"{_name}_quadratic", "growth", {"x1": "x1", "sq": "heat_sq"}[_x], _TWO))
    if _controls:
        _SHAPES.append(_fit_sql(f"{_name}_qx2", "st", "growth", "x2", ["x1", "sq"]))
        _SHAPE_ROWS.append(_rows_sql(f"{_name}_qx2", f"{_name}_quadratic", "growth", "x2", _TWO))
    for _k in _DUMMIES:
        _SHAPES.append(_fit_sql(f"{_name}_{_k}", "st", "growth", _k, [*[o for o in _DUMMIES if o != _k], *_controls]))
        _SHAPE_ROWS.append(_rows_sql(f"{_name}_{_k}", f"{_name}_bins", "growth", f"bin_{_k[1]}", _TWO))
    for _t in ("low", "mid", "high"):
        _SHAPES.append(_fit_sql(f"{_name}_{_t}", f"st_{_t}", "growth", "x1", _controls))
        _SHAPE_ROWS.append(_rows_sql(f"{_name}_{_t}", f"{_name}_income_{_t}", "growth", "x1", _TWO))
_EXTRA = " union all ".join(
    f"""select '{n}_quadratic', 'growth', 'turning_point', 'clustered_entity', round(-a.beta / (2 * b.beta), 6), null, null, null, round(a.r2, 6), cast(a.n as int), cast(a.u as int) from {n}_qx1_b a, {n}_qsq_b b union all
    select '{n}_bins', 'growth', 'monotonic', 'none', case when (b3 >= b2 and b4 >= b3 and b5 >= b4) or (b3 <= b2 and b4 <= b3 and b5 <= b4) then 1.0 else 0.0 end, null, null, null, r2, n, u
      from (select {", ".join(f"(select beta from {n}_{k}_b) as b{k[1]}" for k in _DUMMIES)}, round(r2, 6) as r2, cast(n as int) as n, cast(u as int) as u from {n}_d2_b)"""
    for n, _ in _SETS
)


@query(f"""with {UNITS}, {XYZ}, {_PAIRS}, cuts as (select quantile_cont(x1, [0.2, 0.4, 0.6, 0.8]) as q from units), md as (select unit, median(level) as v from units group by 1), te as (select quantile_cont(v, 1 / 3) as a, quantile_cont(v, 2 / 3) as b from md),
  st as (select unit, year, country, y as growth, x1, x2, x1 * x1 as sq, {", ".join(f"cast((case when x1 > q[{k - 1}] then 1 else 0 end) - (case when x1 > q[{k}] then 1 else 0 end) as double) as d{k}" if k < 5 else "cast(case when x1 > q[4] then 1 else 0 end as double) as d5" for k in range(2, 6))},
    case when v > b then 'high' when v > a then 'mid' else 'low' end as tercile from units join md using (unit), cuts, te),
  {", ".join(f"st_{t} as (select * from st where tercile = '{t}')" for t in ("low", "mid", "high"))}, {", ".join(_SHAPES)} {_tidy_sql(" union all ".join(_SHAPE_ROWS))} union all {_EXTRA}""")
def regression_shapes(spark, d):
    """EC11, EC12, EC14, AG24, AG25, FL10, PJ5: squares with their turning point, quintiles with their monotonicity, and terciles of income, under both control sets."""
    return _tidy(specs.regression_table(study(spark, d), CONTROL_SETS, [specs.quadratic, specs.bins, terciles_of_any_size]))


@query(f"""with {UNITS}, {XYZ}, {_PAIRS}, l0 as (select unit, year, country, x1, y as growth from units), l1 as (select h.unit, h.year, h.country, h.x1, g.y as growth from units h join units g on g.unit = h.unit and g.year = h.year + 1),
  {_fit_sql("f0", "l0", "growth", "x1", [])}, {_fit_sql("f1", "l1", "growth", "x1", [])}
  {_tidy_sql(_rows_sql("f0", "contemporaneous", "growth", "x1", ["clustered_entity", "conley_500"]) + " union all " + _rows_sql("f1", "lead_1", "growth", "x1", ["clustered_entity", "conley_500"]))}""")
def lag_structure(spark, d):
    """EC15."""
    s = study(spark, d)
    u = units(spark, d)
    s.year = "year_heat"
    rows = specs.lags(s, u.select("unit", F.col("year").alias("year_heat"), "country", "x1"), u.select("unit", F.col("year").alias("year_gdp"), F.col("y").alias("growth")))
    s.close()
    return _tidy(specs.tidy(spark, rows))


KINDS = f"""{WITHIN}, b as (select sum(x1*y) / sum(x1*x1) as beta, sum(x1*x1) as xx, count(*) as n, count(distinct unit) as u, count(distinct year) as t from w),
  e as (select unit, year, x1, y - beta*x1 as e from w, b), h as (select sum(x1*e) as s, row_number() over (order by year) as i from e group by year)"""


@query(f"""with {KINDS} select 'kernel' as kind, round(sqrt(((select sum(s*s) from h) + 2 * (select sum((1 - (b.i - a.i) / 6) * a.s * b.s) from h a join h b on b.i - a.i between 1 and 5)) * n / (n - u - t)) / xx, 6) as se from b
  union all select 'robust', round(sqrt((select sum(x1*e*x1*e) from e) * n / (n - u - t)) / xx, 6) from b union all select 'unadjusted', round(sqrt((select sum(e*e) from e) / (n - u - t) / xx), 6) from b""")
def covariance_kinds(spark, d):
    """EC5, EC6: kernel over years, robust and unadjusted."""
    return fitted(within(spark, d), lambda fit: [(k, standard_error(fit.covariance(k))) for k in ("kernel", "robust", "unadjusted")], "kind string, se double")


# supplier-years with small mean discounts count as not observed: an unbalanced panel
SEEN = "x1 >= 0.47"
_ROUNDS = 14


def _projected_sql() -> str:
    """Unit means and year means out in turns until nothing is left of either: the two-way residuals of any panel."""
    steps = [f"{UNITS}, w0 as (select unit, year, y, x1 from units where {SEEN})"]
    for i in range(2 * _ROUNDS):
        by = "unit" if i % 2 == 0 else "year"
        steps.append(f"w{i + 1} as (select unit, year, y - avg(y) over (partition by {by}) as y, x1 - avg(x1) over (partition by {by}) as x1 from w{i})")
    return ", ".join(steps)


@query(f"with {_projected_sql()} select unit, year, round(y, 5) as y, round(x1, 5) as x1 from w{2 * _ROUNDS}")
def twoway_within_unbalanced(spark, d):
    """WN4 where units lack years."""
    u = within(spark, d, units(spark, d).where(SEEN))
    return u.select("unit", "year", r("y", 5).alias("y"), r("x1", 5).alias("x1"))


@query(f"with {_projected_sql()}, b as (select sum(x1*y) / sum(x1*x1) as beta, count(*) as n from w{2 * _ROUNDS}) select round(beta, 5) as beta, n from b")
def fe_ols_unbalanced(spark, d):
    """EC3 where units lack years."""
    return fitted(within(spark, d, units(spark, d).where(SEEN)), lambda fit: [(round(float(fit.beta[0]), 5), fit.n)], "beta double, n long")


_HEAT = "heat as (select unit as GID_2, country as iso3, year, case when x1 >= 0.42 then x1 end as heat_freq_weighted, level as gdp_per_capita from units)"


@query(f"""with {UNITS}, {_HEAT}, j as (select h.GID_2, h.iso3, h.year as year_heat, g.year as year_gdp, heat_freq_weighted, gdp_per_capita, g.y as admin2_growth from heat h join units g on g.unit = h.GID_2 and g.year = h.year where heat_freq_weighted is not null and g.y is not null),
  m as (select GID_2, median(gdp_per_capita) as v from j group by 1), e as (select quantile_cont(v, 1 / 3) as a, quantile_cont(v, 2 / 3) as b from m), t as (select GID_2, case when v > b then 'high' when v > a then 'mid' else 'low' end as income_tercile from m, e)
  select j.GID_2, year_heat, year_gdp, income_tercile, round(heat_freq_weighted, 6) as heat_freq_weighted, round(admin2_growth, 6) as admin2_growth, round(c.x2, 6) as annual_temp_c, round(c.x2 * c.x2, 6) as annual_temp_c_sq
  from j join t using (GID_2) join units c on c.unit = j.GID_2 and c.year = year_heat where c.x2 >= 2.3""")
def panel_assembly(spark, d):
    """EC1, JN9, JN10, FL15, PJ13, SO1: heat, growth and controls as one panel; units and rows must suffice."""
    u = units(spark, d)
    heat = u.select(F.col("unit").alias("GID_2"), F.col("country").alias("iso3"), "year", F.when(F.col("x1") >= 0.42, F.col("x1")).alias("heat_freq_weighted"), F.col("level").alias("gdp_per_capita"))
    growth = u.select(F.col("unit").alias("GID_2"), "year", F.col("y").alias("admin2_growth"))
    controls = u.select(F.col("unit").alias("GID_2"), "year", F.when(F.col("x2") >= 2.3, F.col("x2")).alias("annual_temp_c"), F.lit(1.0).alias("annual_precip_mm"))
    out = panel.assemble(heat, growth, controls)
    if not panel.require_sample(out, "GID_2", rows=100, units=10):
        raise ValueError("the panel has too few rows or units")
    own = out.select("GID_2", "year_heat", "year_gdp", "income_tercile", *[r(c).alias(c) for c in ("heat_freq_weighted", "admin2_growth", "annual_temp_c", "annual_temp_c_sq")])
    return tables.sorted_panel(own, "GID_2", "year_heat")


@query(f"with {UNITS}, q as (select country, year, avg(y) as y from units group by 1, 2), s as (select country, y - lag(y) over (partition by country order by year) as d from q) select country, coalesce(bool_and(d >= 0) or bool_and(d <= 0), true) as monotonic from s group by 1")
def monotonic_test(spark, d):
    """AG25: do the values of a group, in order, never fall or never rise?"""
    means = units(spark, d).groupBy("country", "year").agg(F.avg("y").alias("y"))
    return panel.monotonic_steps(means, "year", "y", ["country"])


_FIXED = "case when {c} >= 0 then '+' else '' end || printf('%.5f', {c})"
_BASELINES = " union all ".join(_rows_sql(f"{name}_growth", f"{name}_baseline", "growth", "x1", _TWO) for name, _ in _SETS)


@query(f"""with {UNITS}, {XYZ}, {_PAIRS}, st as (select unit, year, country, y as growth, x1, x2, y - x2 as residual from units), {_MAIN},
  tested as (select *, {tail_sql('beta / se', 'df')} as p from ({_BASELINES}))
  select spec, variable, se_type, {_FIXED.format(c="beta")} as beta, {_FIXED.format(c="se")} as se, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' when p < 0.1 then '+' else '' end as stars, cast(n as int) as n_obs, cast(u as int) as n_entities from tested""")
def report_table(spark, d):
    """SK8, SF14, SF13: results as the console report has them, with fixed decimals and stars."""
    return specs.report_lines(specs.regression_table(study(spark, d), CONTROL_SETS, [specs.baseline]))


@query("select n_name as name, cast(n_regionkey as int) as region, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey group by 1, 2")
def lookup_csv(spark, d):
    """SC8, SC15, SK5: a lookup written as CSV where the configuration says, read back by its schema, and joined."""
    place = Config(output=tables.scratch_table(spark, "configured")).table("lookup")
    read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").write.csv(place, header=True)
    lookup = tables.read_csv(spark, place, "n_nationkey int, n_name string, n_regionkey int")
    own = read(spark, d, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    out = lookup.join(own, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {UNITS} select cast(unit as varchar) as unit, cast(year as varchar) as year, printf('%.8f', x1) as x1, case when x2 >= 2.5 then printf('%.8f', x2) end as x2 from units")
def report_csv(spark, d):
    """SK3, SO2: a table written as CSV with eight decimals and gaps as empty fields, in order, and read back as text."""
    place = tables.scratch_table(spark, "report")
    u = units(spark, d).select("unit", "year", "x1", F.when(F.col("x2") >= 2.5, F.col("x2")).otherwise(F.lit(float("nan"))).alias("x2"))
    tables.write_report(tables.sorted_panel(u, "unit", "year"), place)
    return spark.read.csv(place, header=True)


@query(f"with {DAILY} select cell, round(avg(cast(value / 10000 + 273.15 as double)) - 273.15, 4) as celsius, 'degC' as unit from daily group by 1")
def celsius_means(spark, d):
    """PJ1, PJ14, SC7: kelvins to degrees, with the unit as an attribute that the file keeps; only the columns asked for are read back."""
    place = tables.scratch_table(spark, "kelvin")
    k = daily(spark, d).groupBy("cell").agg(F.avg(F.col("value") / 10000 + 273.15).alias("t2m_k"))
    held = k.withColumn("t2m", scalar.celsius("t2m_k"))
    tables.described(held, "t2m", units="degC").write.parquet(place)
    back = tables.read_table(spark, place, columns=["cell", "t2m"])
    unit = spark.read.parquet(place).schema["t2m"].metadata["units"]
    return back.select("cell", r("t2m", 4).alias("celsius"), F.lit(unit).alias("unit"))


# ---- ensembles -----------------------------------------------------------------------------------------

MEMBERS = "members as (select cast(l_partkey % 12 as int) as cell, cast(year(l_shipdate) as int) as hDate, cast(l_shipdate as date) as inidate, l_linenumber as number, l_extendedprice as value from lineitem)"


def members(spark, d) -> DataFrame:
    lines = read(spark, d, "lineitem", "l_partkey", "l_shipdate", "l_linenumber", "l_extendedprice")
    return lines.select((F.col("l_partkey") % 12).cast("int").alias("cell"), F.year("l_shipdate").alias("hDate"), F.to_date("l_shipdate").alias("inidate"), F.col("l_linenumber").alias("number"), F.col("l_extendedprice").alias("value"))


@query(f"with {MEMBERS}, x as (select cell, hDate + (case when month(inidate) = 12 then 1 else 0 end) as hDate, value from members where month(inidate) in (12, 1, 2)) select cell, cast(hDate as int) as hDate, count(*) as n, round(sum(value), 2) as total from x where hDate between 1996 and 2001 group by 1, 2")
def djf_assembly(spark, d):
    """ST1, ST2."""
    rows = ensemble.assemble_djf(members(spark, d), years=(1996, 2001))
    return rows.groupBy("cell", "hDate").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


PROB = f"{MEMBERS}, lim as (select cell, cast(dayofyear(inidate) as int) as doy, quantile_cont(value, 0.9) as thresh from members where hDate <= 1999 group by 1, 2), pr as (select m.hDate, m.cell, avg(case when value >= thresh then 1.0 else 0.0 end) as prob, count(*) as n from members m left join lim on lim.cell = m.cell and lim.doy = least(dayofyear(inidate), 365) group by 1, 2)"


def probability(spark, d, floor: bool) -> DataFrame:
    m = members(spark, d)
    lim = m.where("hDate <= 1999").groupBy("cell", F.dayofyear("inidate").alias("dayofyear")).agg(METHODS["linear"]("value", 90).alias("thresh"))
    p = ensemble.exceedance_probability(m, lim, ["cell"], ["hDate"], "value", "inidate", last_day=365, floor=floor)
    return p.withColumns({"prob": r("prob"), "log_prob": r("log_prob")})


@query(f"with {PROB} select hDate, cell, round(prob, 6) as prob, case when prob > 0 then round(ln(prob), 6) end as log_prob from pr")
def ensemble_prob(spark, d):
    """AG19, JN3, SF5 without a floor; day 366 is held against the limit of day 365."""
    return probability(spark, d, False)


@query(f"with {PROB} select hDate, cell, round(prob, 6) as prob, round(ln(case when prob > 0 then prob else 1 / n end), 6) as log_prob from pr")
def ensemble_prob_floor(spark, d):
    """AG19 with the floor of one member."""
    return probability(spark, d, True)


@query(f"with {MEMBERS}, e as (select hDate, cell, avg(value) as value from members group by 1, 2) select hDate, cell, round(value, 4) as value, round(value - avg(value) over (partition by cell), 4) as anomaly from e")
def ensemble_anomaly(spark, d):
    """AG20."""
    e = ensemble.anomaly(ensemble.ensemble_mean(members(spark, d), ["cell"], ["hDate"], "value"), ["cell"], "value")
    return e.select("hDate", "cell", r("value", 4).alias("value"), r("anomaly", 4).alias("anomaly"))


@query(f"""with {UNITS}, f as (select country, regr_slope(y, x1) as slope, regr_sxx(y, x1) as sxx, regr_syy(y, x1) as syy, regr_sxy(y, x1) as sxy, count(*) as n from units group by 1)
  select country, round(slope, 6) as slope, round(sqrt((1 - sxy*sxy/(sxx*syy)) * syy / sxx / (n - 2)), 6) as stderr, n from f""")
def pointwise_ols(spark, d):
    """AG21, FL8; the p-value is checked in tests."""
    fit = ensemble.pointwise_ols(units(spark, d), ["country"], "x1", "y")
    return fit.select("country", r("slope").alias("slope"), r("stderr").alias("stderr"), "n")


@query(f"""with {UNITS}, f as (select unit, regr_slope(y, x1) as slope, regr_sxx(y, x1) as sxx, regr_syy(y, x1) as syy, regr_sxy(y, x1) as sxy, count(*) as n from units group by 1 having count(*) >= 2),
  e as (select unit, slope, n, case when n > 2 then slope / sqrt((1 - sxy*sxy/(sxx*syy)) * syy / sxx / (n - 2)) end as t from f), p as (select unit, slope, {tail_sql("t", "(n - 2)")} as p from e)
  select unit, case when p <= 0.05 then round(slope, 6) end as slope, round(p, 6) as p_value, round(exp(case when p <= 0.05 then slope end), 6) as risk_ratio from p""")
def significance_filter(spark, d):
    """FL12, SF11, SF16."""
    fit = ensemble.pointwise_ols(units(spark, d), ["unit"], "x1", "y")
    out = ensemble.significant(fit, ["slope"]).withColumn("risk_ratio", ensemble.risk_ratio("slope"))
    return out.select("unit", r("slope").alias("slope"), r("p_value").alias("p_value"), r("risk_ratio").alias("risk_ratio"))


@query(f"""with {MEMBERS}, a as (select cell, value / 10000 - avg(value / 10000) over (partition by cell) as v from members), c as (select cell, quantile_cont(v, 0.95) as cut from a group by 1),
  t as (select cell, v, row_number() over (partition by cell order by v) - 1 as k, count(*) over (partition by cell) as n from a join c using (cell) where v >= cut),
  l as (select cell, v, ln(1 - k / n) as l, n from t), f as (select cell, regr_slope(l, v) as b, regr_sxx(l, v) as sxx, regr_syy(l, v) as syy, regr_sxy(l, v) as sxy, count(*) as n from l group by 1)
  select cell, case when n >= 10 then round(exp(-b), 4) end as slope, case when n >= 10 then round(exp(-b) * sqrt(greatest(syy - sxy*sxy/sxx, 0) / (n - 2) / sxx), 4) end as stderr, n as n_tail from f""")
def tail_slope(spark, d):
    """AG22, WN8, SO4, FL13."""
    t = ensemble.tail_slope(members(spark, d).withColumn("value", F.col("value") / 10000), ["cell"], "value")
    return t.withColumns({"slope": r("slope", 4), "stderr": r("stderr", 4)})


@query(f"with {PLACES} select id, lat, case when lat >= 0 then 'north' else 'south' end as side from places")
def hemisphere_stitch(spark, d):
    """ST4."""
    p = places(spark, d).select("id", "lat")
    return ensemble.stitch_hemispheres(p.withColumn("side", F.lit("north")), p.withColumn("side", F.lit("south")))


_S_LAT = 800.0 / ensemble.KM_PER_LAT / 10.0
_R_LAT = int(4 * _S_LAT + 0.5)


@query(f"""with g as (select cast(c_custkey % 19 as int) as lat_i, cast(c_custkey % 36 as int) as lon_i, avg(c_acctbal) as value from customer group by 1, 2),
  v as (select o, exp(-0.5 * (o / {_S_LAT}::double) ** 2) / sum(exp(-0.5 * (o / {_S_LAT}::double) ** 2)) over () as w from range({-_R_LAT}, {_R_LAT + 1}) t(o)),
  a as (select j as lat_i, lon_i, sum(value * w) as value from range(19) t(j), v, g where lat_i = least(greatest(j + o, 0), 18) group by 1, 2),
  p as (select j as lat_i, least({800.0 / ensemble.KM_PER_LON / 10.0}::double / greatest(cos(radians(90 - j * 10.0::double)), 0.05::double), {max(3 * _S_LAT, 200.0)}::double) as s from range(19) t(j)),
  h as (select lat_i, o, exp(-0.5 * (o / s) ** 2) / sum(exp(-0.5 * (o / s) ** 2)) over (partition by lat_i) as w from p, range(-900, 901) t(o) where abs(o) <= cast(floor(4 * s + 0.5) as int)),
  b as (select a.lat_i, ((a.lon_i + o) % 36 + 36) % 36 as lon_i, sum(value * w) as value from a join h using (lat_i) group by 1, 2)
  select 0 as hDate, cast(lat_i as int) as lat_i, cast(lon_i as int) as lon_i, round(b.value, 4) as value from b semi join g using (lat_i, lon_i)""")
def smooth_kernel(spark, d):
    """WN5, WN6, SF15: a Gaussian of 800 km on a coarse grid."""
    k = F.col("c_custkey")
    g = read(spark, d, "customer").select(F.lit(0).alias("hDate"), (k % 19).cast("int").alias("lat_i"), (k % 36).cast("int").alias("lon_i"), F.col("c_acctbal").alias("value"))
    g = g.groupBy("hDate", "lat_i", "lon_i").agg(F.avg("value").alias("value"))
    return ensemble.smooth(g, "value", ["hDate"], 10.0, 19, 36, radius_km=800.0).withColumn("value", r("value", 4))


def _mirrored_sql(table: str, axis: str, other: str, n: int) -> str:
    at = f"((j + o + {8 * n}) % {2 * n})"
    return f"select j as {axis}, {other}, sum(value * w) as value from range({n}) t(j), w, {table} where {axis} = case when {at} >= {n} then {2 * n - 1} - {at} else {at} end group by 1, 2"


@query(f"""with g as (select cast(c_custkey % 19 as int) as lat_i, cast(c_custkey % 36 as int) as lon_i, avg(c_acctbal) as value from customer group by 1, 2),
  w as (select o, exp(-0.5 * (o / 2.0) ** 2) / (select sum(exp(-0.5 * (i / 2.0) ** 2)) from range(-8, 9) t(i)) as w from range(-8, 9) t(o)),
  a as ({_mirrored_sql("g", "lat_i", "lon_i", 19)}), b as ({_mirrored_sql("a", "lon_i", "lat_i", 36)})
  select 0 as hDate, cast(lat_i as int) as lat_i, cast(lon_i as int) as lon_i, round(b.value, 4) as value from b semi join g using (lat_i, lon_i)""")
def smooth_mirrored(spark, d):
    """WN6."""
    k = F.col("c_custkey")
    g = read(spark, d, "customer").groupBy((k % 19).cast("int").alias("lat_i"), (k % 36).cast("int").alias("lon_i")).agg(F.avg("c_acctbal").alias("value"))
    return ensemble.smooth_isotropic(g.withColumn("hDate", F.lit(0)), "value", ["hDate"], 2.0, 19, 36).withColumn("value", r("value", 4))


@query(f"with {UNITS} select unit, round(sum(x1), 4) as total from units where x1 between 0 and 1 group by 1")
def range_check(spark, d):
    """AG26: shares that must lie in [0, 1]."""
    return panel.check_range(units(spark, d), "x1").groupBy("unit").agg(r(F.sum("x1"), 4).alias("total"))
