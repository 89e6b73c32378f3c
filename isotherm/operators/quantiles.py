"""Exact order statistics of a whole column, without sorting it and without one task that holds it.

Each pass is a histogram: a grouped count over the bins of a few value ranges, combined before
the shuffle.  A rank falls into one bin, whose least and greatest values are
the next pass's range, so the ranges shrink to the ranks sought; all ranks are refined together.  Once
the bins that hold a rank are small, one last pass fetches their distinct values.  The
driver sees at most ``BINS`` rows per rank and pass, however many rows there are.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.scalar import missing_is_null

BINS = 2048


@dataclass(frozen=True)
class Range:
    """Values from ``low`` to ``high``, both of which occur; ``before`` rows are less, ``rows`` are within."""

    low: float
    high: float
    before: int
    rows: int


def _bin(v: Column, r: Range, bins: int) -> Column:
    """A bin number that never falls as the value rises; the extremes of the range are in the first and the last."""
    span = r.high - r.low
    share = (v - F.lit(r.low)) / F.lit(span) if math.isfinite(span) else (v / 2 - F.lit(r.low / 2)) / F.lit(r.high / 2 - r.low / 2)
    return F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))


def _refine(values: DataFrame, ranges: list[Range], bins: int) -> dict[Range, list[Range]]:
    """Bins (with values) of each range, in order; a range of few rows comes back value by value."""
    v, whole = F.col("v"), functools.reduce(lambda a, b: a | b, [F.col("v").between(r.low, r.high) for r in ranges])
    # a value's own number in a small range is the value itself, else its bin
    number, cell = F.lit(0), F.lit(None).cast("double")
    for i, r in enumerate(ranges):
        inside = v.between(r.low, r.high)
        number = F.when(inside, F.lit(i)).otherwise(number)
        cell = F.when(inside, v if r.rows <= bins else _bin(v, r, bins).cast("double")).otherwise(cell)
    found = values.where(whole).groupBy(number.alias("i"), cell.alias("cell")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("rows")).collect()
    out = {}
    for i, r in enumerate(ranges):
        before, parts = r.before, []
        for row in sorted((x for x in found if x.i == i), key=lambda x: x.low):
            parts.append(Range(row.low, row.high, before, row.rows))
            before += row.rows
        out[r] = parts
    return out


def order_statistics(values: DataFrame, ranks: set[int], first: Range, bins: int = BINS) -> dict[int, float]:
    """The ``v`` of each rank (from 0) of ``values``, whose extremes and number ``first`` holds."""
    open_ = {first: set(ranks)}
    out: dict[int, float] = {}
    while open_:
        for r in [r for r in open_ if r.low == r.high]:
            out |= dict.fromkeys(open_.pop(r), r.low)
        if not open_:
            break
        deeper: dict[Range, set[int]] = {}
        for r, parts in _refine(values, list(open_), bins).items():
            for k in open_[r]:
                part = next(p for p in parts if p.before <= k < p.before + p.rows)
                deeper.setdefault(part, set()).add(k)
        open_ = deeper
    return out


def quantiles(df: DataFrame, value: str, shares: list[float], distinct: bool = False, bins: int = BINS) -> list[float] | None:
    """Exact quantiles with linear interpolation between ranks, all at once; ``distinct``: of the different values.

    Missing values (null or NaN) are left out; nothing of none.  An infinite value is one like any other, but
    nothing lies between it and a finite one.  The column is held while it is read, in memory or on disk.
    """
    v = missing_is_null(F.col(value).cast("double"))
    values = df.select(v.alias("v")).where("v is not null")
    values = (values.distinct() if distinct else values).persist()
    try:
        endless = [F.count_if(F.col("v") == F.lit(x)) for x in (-math.inf, math.inf)]
        finite = F.when(F.abs(F.col("v")) < F.lit(math.inf), F.col("v"))
        low, high, n, under, over = values.agg(F.min(finite), F.max(finite), F.count("*"), *endless).first()
        if not n:
            return None
        places = [p * (n - 1) for p in shares]
        ranks = {k for p in places for k in (math.floor(p), math.ceil(p))}
        known = {k: -math.inf for k in ranks if k < under} | {k: math.inf for k in ranks if k >= n - over}
        inner = ranks - known.keys()
        if inner:
            known |= order_statistics(values.where(F.abs(F.col("v")) < F.lit(math.inf)), inner, Range(low, high, under, n - under - over), bins)
        return [_between(known[math.floor(p)], known[math.ceil(p)], p - math.floor(p)) for p in places]
    finally:
        values.unpersist()


def _between(a: float, b: float, share: float) -> float:
    """From ``a`` by its share of the way: a weighted sum of the two is rounded thrice, and between close values may come out as ``b`` itself, so that rows at ``b`` change bins."""
    if a == b or not share:
        return a
    return a + (b - a) * share if math.isfinite(b - a) else a * (1 - share) + b * share
