"""Integer cell keys of regular grids.

Latitude counts down from the north, longitude up from the west, in whole
steps.  Indices round half to even; longitudes wrap and are never clipped
(``edge="clip"`` gives the clipped form for comparison).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Name = str | Column


def _c(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lat_index(lat: Name, step: float, north: float = 90.0) -> Column:
    return F.rint((F.lit(north) - _c(lat)) / F.lit(step)).cast("int")


def lon_index(lon: Name, step: float, west: float = -180.0, edge: str = "wrap") -> Column:
    n = round(360 / step)
    i = F.rint((_c(lon) - F.lit(west)) / F.lit(step)).cast("int")
    return F.pmod(i, F.lit(n)) if edge == "wrap" else F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))


def lat_of(lat_i: Name, step: float, north: float = 90.0) -> Column:
    return F.round(F.lit(north) - _c(lat_i) * F.lit(step), 6)


def lon_of(lon_i: Name, step: float, west: float = -180.0) -> Column:
    return F.round(F.lit(west) + _c(lon_i) * F.lit(step), 6)


def half_turn(lon_i: Name, n: int) -> Column:
    """Index from 0..360 longitudes to -180..180 ones, and back."""
    return F.pmod(_c(lon_i) + F.lit(n // 2), F.lit(n)).cast("int")


def wrap_degrees(lon: Name) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(_c(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def coarser_index(i: Name, step: float, to: float, n: int | None = None, edge: str = "wrap") -> Column:
    """Index on a grid of step ``to`` that shares the origin; ``n``: cells of a circle of longitudes."""
    j = F.rint(_c(i) * F.lit(step) / F.lit(to)).cast("int")
    if n is None:
        return j
    return F.pmod(j, F.lit(n)) if edge == "wrap" else F.least(j, F.lit(n - 1))


def in_box(lat: Name, lon: Name, south: float, north: float, west: float, east: float) -> Column:
    """A box; ``west > east`` crosses the date line."""
    lat, lon = _c(lat), _c(lon)
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def axes(spark: SparkSession, n_lat: int, n_lon: int) -> DataFrame:
    """All cells of a grid, generated by index arithmetic."""
    return spark.range(n_lat * n_lon).select((F.col("id") / n_lon).cast("int").alias("lat_i"), (F.col("id") % n_lon).cast("int").alias("lon_i"))


def mollweide_inverse(x: Name, y: Name, radius: float = 6378137.0) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of Mollweide metres; NULL outside the ellipse."""
    x, y = _c(x), _c(y)
    s = y / F.lit(radius * math.sqrt(2))
    theta = F.when(F.abs(s) <= 1, F.asin(s))
    lat = F.degrees(F.asin((2 * theta + F.sin(2 * theta)) / F.lit(math.pi)))
    lon = F.degrees(F.lit(math.pi) * x / (F.lit(2 * radius * math.sqrt(2)) * F.cos(theta)))
    return lat, F.when(F.abs(lon) <= 180, lon)


def tile_label(lat_i: Name, lon_i: Name, rows: int, columns: int) -> Column:
    return F.format_string("r%02d_c%02d", (_c(lat_i) / rows).cast("int"), (_c(lon_i) / columns).cast("int"))
