"""Ensemble reforecasts as long rows (hDate, inidate, number, lat_i, lon_i, value)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from isotherm.functions.scalar import finite
from isotherm.functions.stats import t_tail
from isotherm.operators.exceedance import exceeds


def assemble_djf(months: DataFrame, extra_december: DataFrame | None = None, year: str = "hDate", date: str = "inidate", years: tuple[int, int] | None = None) -> DataFrame:
    """December counts to the next year's winter; an extra December set joins by name; winters outside ``years`` leave."""
    rows = months if extra_december is None else months.unionByName(extra_december.where(F.month(date) == 12))
    rows = rows.where(F.month(date).isin(12, 1, 2)).withColumn(year, F.col(year) + (F.month(date) == 12).cast("int"))
    return rows if years is None else rows.where(F.col(year).between(*years))


def init_day(date: str, last: int | None = None) -> Column:
    """Calendar day of an initial date, not beyond ``last``."""
    d = F.dayofyear(date)
    return d if last is None else F.least(d, F.lit(last))


def exceedance_probability(members: DataFrame, limits: DataFrame, cell: list[str], by: list[str], value: str, date: str, last_day: int | None = None, limit: str = "thresh", floor: bool = False) -> DataFrame:
    """``by..., cell..., prob, log_prob``: share of members at or above the limit of their initial calendar day.

    The log of probability 0 is NULL, or, with ``floor``, that of one in the number of members.
    """
    keyed = members.withColumn("dayofyear", init_day(date, last_day)).join(limits, [*cell, "dayofyear"], "left")
    p = F.avg(exceeds(F.col(value), F.col(limit), inclusive=True).cast("double"))
    out = keyed.groupBy(*by, *cell).agg(p.alias("prob"), F.count("*").alias("n"))
    safe = F.when(F.col("prob") > 0, F.col("prob")).otherwise(1 / F.col("n") if floor else F.lit(None))
    return out.withColumn("log_prob", F.ln(safe)).drop("n")


def ensemble_mean(members: DataFrame, cell: list[str], by: list[str], value: str) -> DataFrame:
    return members.groupBy(*by, *cell).agg(F.avg(value).alias(value))


def anomaly(df: DataFrame, cell: list[str], value: str, to: str = "anomaly") -> DataFrame:
    return df.withColumn(to, F.col(value) - F.avg(value).over(Window.partitionBy(*cell)))


def pointwise_ols(df: DataFrame, cell: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """Slope, standard error and p-value per cell over finite pairs; all in built-in aggregates and expressions."""
    rows = df.where(finite(x) & finite(y))
    fit = rows.groupBy(*cell).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_count(y, x).alias("n")
    ).where(F.col("n") >= least)
    r2 = F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))
    se = F.when((F.col("n") > 2) & (F.col("sxx") > 0) & (F.col("syy") > 0), F.sqrt(F.greatest(1 - r2, F.lit(0.0)) * F.col("syy") / F.col("sxx") / (F.col("n") - 2)))
    out = fit.withColumn("stderr", se)
    t = F.when(F.col("stderr") > 0, F.col("slope") / F.col("stderr"))
    return out.withColumn("p_value", F.when(F.col("stderr") == 0, 0.0).otherwise(t_tail(t, (F.col("n") - 2).cast("double")))).select(*cell, "slope", "p_value", "stderr", "n")


def significant(df: DataFrame, columns: list[str], p: str = "p_value", level: float = 0.05) -> DataFrame:
    """Values with a larger p become NULL; their rows stay."""
    return df.withColumns({c: F.when(F.col(p) <= level, F.col(c)) for c in columns})


def tail_slope(df: DataFrame, cell: list[str], value: str, percent: float = 95.0, least: int = 10) -> DataFrame:
    """Exponential tail per cell: demeaned values at or above their percentile against the log of their exceedance rank.

    With k the number of smaller tail values and n the tail's size, ln(1 - k / n) = a + b v; ``slope`` is
    1 / exp(b), ``stderr`` its standard error; NULL below ``least`` values.
    """
    # the cut is one of the values as they are, and a cell's mean is found once: two sums of a cell in two orders may
    # differ in the last digit, and values that repeat at the cut would be in the tail by one mean and not by the other
    d = df.where(finite(value)).withColumn("_v", F.col(value).cast("double"))
    known = d.groupBy(*cell).agg(F.percentile("_v", F.lit(percent / 100)).alias("_cut"), F.avg("_v").alias("_mean"))
    tail = d.join(known, cell).where(F.col("_v") >= F.col("_cut")).withColumn("_v", F.col("_v") - F.col("_mean"))
    by = Window.partitionBy(*cell)
    rank = tail.withColumn("_k", F.row_number().over(by.orderBy("_v")) - 1).withColumn("_n", F.count("*").over(by))
    points = rank.withColumn("_l", F.ln(1 - F.col("_k") / F.col("_n")))
    fit = points.groupBy(*cell).agg(F.regr_slope("_l", "_v").alias("b"), F.regr_sxx("_l", "_v").alias("sxx"), F.regr_syy("_l", "_v").alias("syy"), F.regr_sxy("_l", "_v").alias("sxy"), F.count("*").alias("n_tail"))
    se = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / (F.col("n_tail") - 2) / F.col("sxx"))
    enough = (F.col("n_tail") >= least) & (F.col("sxx") > 0)
    slope = F.when(enough, F.exp(-F.col("b")))
    return fit.select(*cell, slope.alias("slope"), F.when(enough, se * slope).alias("stderr"), "n_tail")


def stitch_hemispheres(north: DataFrame, south: DataFrame, lat: str = "lat") -> DataFrame:
    """One's cells from the equator north, the other's south of it."""
    return north.where(F.col(lat) >= 0).unionByName(south.where(F.col(lat) < 0))


def risk_ratio(slope: str = "slope") -> Column:
    return F.exp(slope)


# ---- smoothing ---------------------------------------------------------------------------

#: fixed values: kilometres of a degree
KM_PER_LAT, KM_PER_LON = 110.574, 111.320
#: fixed values: least cosine and, in rows of latitude, least cap of the width along a row
LEAST_COS, LEAST_CAP = 0.05, 200.0


def gaussian(sigma: float) -> np.ndarray:
    """Weights of a Gaussian to four sigma on both sides, which add up to 1."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def _along(df: DataFrame, keys: list[str], axis: str, value: str, n: int, edge: str, sigma: Callable[[tuple], float], whole: bool) -> DataFrame:
    """Each line of ``n`` cells (``keys`` name it) as one array, convolved.

    ``edge``: how the line goes on beyond its ends, as ``numpy.pad`` names it.  Missing cells count as 0.  ``known``
    marks cells that had a value at first; with ``whole`` the others are there as well, for the next axis.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(axis, T.IntegerType()), T.StructField(value, T.DoubleType()), T.StructField("known", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = table.column(axis).to_numpy()
        line, known = np.zeros(n), np.zeros(n, dtype=bool)
        line[at] = table.column(value).to_numpy()
        known[at] = table.column("known").to_numpy(zero_copy_only=False)
        w = gaussian(sigma(tuple(k.as_py() for k in key)))
        smooth = np.convolve(np.pad(line, len(w) // 2, mode=edge), w, mode="valid")
        kept = np.arange(n) if whole else np.flatnonzero(known)
        own = [pa.array([k.as_py()] * len(kept), f.type) for k, f in zip(key, arrow, strict=False)]
        return pa.Table.from_arrays([*own, pa.array(kept.astype(np.int32)), pa.array(smooth[kept]), pa.array(known[kept])], schema=arrow)

    return df.groupBy(*keys).applyInArrow(run, schema)


def _values(df: DataFrame, value: str, by: list[str], row: str, column: str) -> DataFrame:
    cells = [F.col(c).cast("int").alias(c) for c in (row, column)]
    return df.where(finite(value)).select(*by, *cells, F.col(value).cast("double").alias(value), F.lit(True).alias("known"))


def smooth(df: DataFrame, value: str, by: list[str], step: float, n_lat: int, n_lon: int, radius_km: float = 200.0, north: float = 90.0, lat: str = "lat_i", lon: str = "lon_i") -> DataFrame:
    """Gaussian of a radius in km: along latitude (ends repeat), then along longitude (wraps), missing cells as 0 and missing again after.

    A grid line is one array: two shuffles of the cells, by column and by row, and no row per neighbour.
    """
    s_lat = radius_km / KM_PER_LAT / step

    def s_lon(key: tuple) -> float:
        cos = max(math.cos(math.radians(north - key[-1] * step)), LEAST_COS)
        return min(radius_km / KM_PER_LON / step / cos, max(3 * s_lat, LEAST_CAP))

    first = _along(_values(df, value, by, lat, lon), [*by, lon], lat, value, n_lat, "edge", lambda key: s_lat, True)
    return _along(first, [*by, lat], lon, value, n_lon, "wrap", s_lon, False).select(*by, lat, lon, value)


def smooth_isotropic(df: DataFrame, value: str, by: list[str], sigma: float, n_rows: int, n_columns: int, row: str = "lat_i", column: str = "lon_i") -> DataFrame:
    """Gaussian of ``sigma`` cells along both axes, edges mirrored, missing cells as 0 and missing again after."""
    first = _along(_values(df, value, by, row, column), [*by, column], row, value, n_rows, "symmetric", lambda key: sigma, True)
    return _along(first, [*by, row], column, value, n_columns, "symmetric", lambda key: sigma, False).select(*by, row, column, value)
