"""Schemas of the long tables, and the one rule for missing values: NaN becomes NULL when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "tmax_daily": "lat_i int, lon_i int, date date, t2m_k float, year int, month int",
    "era5_monthly": "lat_i int, lon_i int, year int, month int, t2m_k float, tp_m_per_day float",
    "built_surface": "x double, y double, epoch int, value float",
    "land_mask": "lat_i int, lon_i int, topo int",
    "reforecast": "hDate int, inidate date, number int, lat_i int, lon_i int, t2m float",
    "threshold_doy": "lat_i int, lon_i int, dayofyear int, threshold_c float",
    "exceedance_frequency": "lat_i int, lon_i int, year int, freq double",
    "admin2_raster": "lat_i int, lon_i int, raster_id int",
    "admin2_lookup": "GID_2 string, adm2ID int, iso3 string, NAME_2 string, raster_id int",
    "heat_panel": "GID_2 string, adm2ID int, iso3 string, NAME_2 string, year int, heat_freq_weighted float, heat_freq_unweighted float, total_settlement_m2 double, n_cells int, gdp_per_capita double, raster_id int",
    "controls": "GID_2 string, iso3 string, year int, annual_temp_c float, annual_precip_mm float, n_cells_025 int",
    "gdp_growth": "GID_2 string, iso3 string, year int, admin2_growth double, residual double, gdp_per_capita double",
    "centroids": "GID_2 string, lat double, lon double",
    "results": "spec string, depvar string, variable string, se_type string, beta double, se double, tstat double, pval double, r2_within double, n_obs int, n_entities int",
}


def missing_as_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """All float and double columns with NaN as NULL; Spark would rank and compare NaN as the largest value."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: missing_as_null(F.col(c)) for c in real}) if real else df


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that exist, in the order given."""
    return df.select(*[c for c in names if c in df.columns])
