"""Scalar expressions: spheres, weights, units, marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isotherm.functions.grid import Name, _c

EARTH_KM = 6371.0


def celsius(kelvin: Name) -> Column:
    return _c(kelvin) - F.lit(273.15)


def millimetres(metres: Name) -> Column:
    return _c(metres) * F.lit(1000.0)


def unit_xyz(lat: Name, lon: Name) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_of_km(km: float) -> float:
    import math

    return 2 * math.sin(km / EARTH_KM / 2)


def km_of_chord(chord: Name) -> Column:
    return F.lit(2 * EARTH_KM) * F.asin(F.least(_c(chord) / 2, F.lit(1.0)))


def bartlett(km: Name, cutoff: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _c(km) / F.lit(float(cutoff))))


def finite(c: Name) -> Column:
    """Neither NULL, NaN nor infinite."""
    c = _c(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def missing_is_null(c: Name) -> Column:
    """NaN as NULL."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def stars(p: Name) -> Column:
    p = _c(p)
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, "+").otherwise("")
