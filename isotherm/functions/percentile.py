"""The two percentiles in use: nearest rank with half-to-even, and linear interpolation.  Nulls are skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isotherm.functions.grid import Name, _c


def nearest_rank(value: Name, percent: float) -> Column:
    """Aggregate: the value at index ``rint(percent / 100 * (n - 1))`` of the sorted values; NULL of none."""
    v = F.sort_array(F.collect_list(_c(value)))
    at = (F.rint(F.lit(percent / 100) * (F.count(_c(value)) - 1)) + 1).cast("int")
    return F.when(F.count(_c(value)) > 0, F.element_at(v, F.greatest(at, F.lit(1))))


def linear(value: Name, percent: float) -> Column:
    return F.percentile(_c(value), F.lit(percent / 100))


def approximate(value: Name, percent: float, accuracy: int = 10_000) -> Column:
    """A sketch instead of the sorted values, where a group is too large to sort."""
    return F.percentile_approx(_c(value), percent / 100, accuracy)


METHODS = {"nearest": nearest_rank, "linear": linear, "approximate": approximate}
