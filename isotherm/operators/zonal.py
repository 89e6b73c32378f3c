"""Grids to coarser grids and to units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.calendar import days_in_month
from isotherm.functions.grid import axes, coarser_index, mollweide_inverse, lat_index, lon_index
from isotherm.functions.scalar import finite, missing_is_null


def coarsen(df: DataFrame, value: str, lead: list[str] = (), step: float = 0.1, to: float = 0.25, edge: str = "wrap", dense: bool = False) -> DataFrame:
    """Mean of the finite source cells whose centre rounds to a target cell; ``dense`` adds target cells without any."""
    n = round(360 / to)
    keyed = df.where(finite(value)).select(*lead, coarser_index("lat_i", step, to).alias("lat_i"), coarser_index("lon_i", step, to, n, edge).alias("lon_i"), value)
    out = keyed.groupBy(*lead, "lat_i", "lon_i").agg(F.avg(value).cast("float").alias(value))
    if not dense:
        return out
    grid = axes(df.sparkSession, round(180 / to) + 1, n)
    if lead:
        # one grid per lead: their number is small against the cells
        grid = df.select(*lead).distinct().withColumn("lat_i", F.explode(F.sequence(F.lit(0), F.lit(round(180 / to))))).withColumn("lon_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(out, [*lead, "lat_i", "lon_i"], "left")


#: fixed values: last year of each five-year settlement epoch but the latest
EPOCH_ENDS = {2002: 2000, 2007: 2005, 2012: 2010, 2017: 2015, 2022: 2020}
LAST_EPOCH = 2025


def epoch_of(year: Column) -> Column:
    """The epoch nearest to a year."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for end, epoch in EPOCH_ENDS.items():
        out = out.when(year <= end, F.lit(epoch))
    return F.when(year.isNotNull(), out.otherwise(F.lit(LAST_EPOCH)))


def weighted_zonal(df: DataFrame, unit: list[str], value: str, weight: str) -> DataFrame:
    """Weighted and plain mean over one mask: finite value and positive weight.  Units without a cell are left out."""
    inside = df.where(finite(value) & finite(weight) & (F.col(weight) > 0))
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    return inside.groupBy(*unit).agg((F.sum(v * w) / F.sum(w)).alias("weighted"), F.avg(v).alias("plain"), F.sum(w).alias("total_weight"), F.count("*").cast("int").alias("n_cells"))


def zonal(df: DataFrame, unit: list[str], value: str) -> DataFrame:
    return df.where(finite(value)).groupBy(*unit).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count("*").cast("int").alias("n_cells"))


def two_zonal(df: DataFrame, unit: list[str], first: str, second: str) -> DataFrame:
    """Means of two values, each over its own valid cells; a unit has a row if the first has a cell."""
    a, b = F.when(finite(first), F.col(first).cast("double")), F.when(finite(second), F.col(second).cast("double"))
    return df.groupBy(*unit).agg(F.avg(a).alias(first), F.avg(b).alias(second), F.count(a).cast("int").alias("n_cells")).where("n_cells > 0")


def annual_mean(monthly: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Mean of the months that have a value."""
    return monthly.groupBy(*cell, "year").agg(F.avg(value).alias(value))


def annual_total(monthly: DataFrame, cell: list[str], rate: str, scale: float = 1000.0, months: int = 12) -> DataFrame:
    """Sum of rate per day times days of the month; NULL unless all months have a value."""
    total = F.sum(F.col(rate).cast("double") * days_in_month("year", "month")) * F.lit(scale)
    return monthly.groupBy(*cell, "year").agg(F.when(F.count(rate) == months, total).alias("total"))


def last_wins(cells: DataFrame, cell: list[str], order: str, value: str | None = None) -> DataFrame:
    """Of overlapping writes to a cell the one of the largest order stays."""
    if value is None:
        return cells.groupBy(*cell).agg(F.max(order).alias(order))
    return cells.groupBy(*cell).agg(F.max_by(value, order).alias(value))


def reproject_built(points: DataFrame, step: float = 0.1) -> DataFrame:
    """Mollweide pixels (x, y, epoch, value) averaged per cell and epoch: missing pixels are left out, a cell of none but missing ones has 0."""
    lat, lon = mollweide_inverse("x", "y")
    keyed = points.select("epoch", lat_index(lat, step).alias("lat_i"), lon_index(lon, step).alias("lon_i"), missing_is_null(F.col("value").cast("double")).alias("value"))
    mean = F.coalesce(F.avg("value"), F.lit(0.0)).cast("float").alias("built_surface")
    return keyed.where("lat_i is not null and lon_i is not null").groupBy("lat_i", "lon_i", "epoch").agg(mean)
