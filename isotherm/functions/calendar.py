"""Calendar days, circular windows and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.grid import Name, _c

#: Days of the circle of calendar days, in every year
CIRCLE = 366


def circular_distance(a: Name, b: Name) -> Column:
    d = F.abs(_c(a) - _c(b))
    return F.least(d, F.lit(CIRCLE) - d)


def pooled_days(df: DataFrame, day: str, half_width: int = 7, to: str = "target_doy") -> DataFrame:
    """Each row once for every calendar day whose window holds it: a band join as an explode and an equi-key."""
    shifts = F.array(*[F.lit(k) for k in range(-half_width, half_width + 1)])
    return df.withColumn(to, F.explode(F.transform(shifts, lambda k: F.pmod(F.col(day) - 1 + k, F.lit(CIRCLE)) + 1)))


def season_year(date: Name, first_month: int = 12) -> Column:
    """Year of the season's end: months from ``first_month`` on belong to the next year."""
    return F.year(_c(date)) + (F.month(_c(date)) >= first_month).cast("int")


def season_label(date: Name) -> Column:
    """``DJF-2001`` and so on; December counts to the next year."""
    m = F.month(_c(date))
    name = F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")
    return F.concat_ws("-", name, season_year(date).cast("string"))


def days_in_month(year: Name, month: Name) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(_c(year), _c(month), F.lit(1))))
