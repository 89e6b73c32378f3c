"""Unit-by-year panels: growth, bins, leads, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.operators.quantiles import quantiles
from isotherm.sources.tables import equal_or_both_null


def melt_years(df: DataFrame, ids: list[str], to: str = "value", year: str = "year") -> DataFrame:
    """Columns whose names are digits become rows."""
    years = [c for c in df.columns if c.isdigit()]
    return df.select(*ids, *years).unpivot(ids, years, year, to).withColumn(year, F.col(year).cast("int"))


def log_growth(df: DataFrame, unit: str, year: str, level: str, to: str = "growth") -> DataFrame:
    """Difference of logs between consecutive rows of a unit; NULL for its first row and for levels without a log."""
    log = F.when(F.col(level) > 0, F.ln(level))
    return df.withColumn(to, log - F.lag(log).over(Window.partitionBy(unit).orderBy(year)))


def demean(df: DataFrame, value: str, by: list[str], to: str) -> DataFrame:
    return df.withColumn(to, F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a missing key meets a missing key."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = equal_or_both_null(F.col(k), F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(named, on, "left").drop(*[f"_r_{k}" for k in keys])


def lead_join(heat: DataFrame, growth: DataFrame, unit: str, heat_year: str = "year_heat", growth_year: str = "year_gdp", lead: int = 1) -> DataFrame:
    """Heat of a year with growth ``lead`` years later; a join on the derived year, as years may be missing."""
    return heat.withColumn(growth_year, F.col(heat_year) + lead).join(growth, [unit, growth_year])


def bin_number(value: Column, edges: Column) -> Column:
    """1 for the lowest bin; bins are open below and closed above, the lowest includes its edge."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    n = F.aggregate(inner, F.lit(1), lambda a, e: a + (value > e).cast("int"))
    return F.when(value.isNotNull(), n)


def qcut(df: DataFrame, value: str, bins: int, to: str, duplicates: str = "raise") -> DataFrame:
    """Bins between exact quantiles; edges that repeat raise, or, with ``drop``, count once.

    The edges (``bins + 1`` numbers) are found first and become literals of the plan.
    """
    edges = quantiles(df, value, [i / bins for i in range(bins + 1)])
    if edges is None:
        return df.withColumn(to, F.lit(None).cast("int"))
    distinct = sorted(set(edges))
    if len(distinct) < len(edges) and duplicates != "drop":
        raise ValueError(f"bin edges are not unique: {edges}")
    return df.withColumn(to, bin_number(F.col(value), F.array(*[F.lit(float(e)) for e in distinct])))


def terciles(df: DataFrame, unit: str, value: str, to: str = "tercile", labels: tuple[str, ...] = ("low", "mid", "high")) -> DataFrame:
    """Each unit's label by the exact median of its values; units without a value have none."""
    medians = df.groupBy(unit).agg(F.median(value).alias("median")).where("median is not null")
    cut = qcut(medians, "median", len(labels), "n")
    marks = cut.select(unit, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("n")).alias(to))
    return df.join(marks, unit, "left")


def dummies(df: DataFrame, column: str, levels: list[int], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{k}": (F.col(column) == k).cast("double") for k in levels})


def summary(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """A row per column (and group): mean, standard deviation (n - 1), extremes, count; one pass."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "variable").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))


def check_range(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``df``, which fails when it is run and a value lies outside."""
    ok = F.col(column).isNull() | F.col(column).between(low, high)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} is out of range: "), F.col(column).cast("string")))))


def require_sample(df: DataFrame, unit: str, rows: int = 1000, units: int = 50) -> bool:
    found = df.agg(F.count("*").alias("rows"), F.countDistinct(unit).alias("units")).first()
    return found.rows >= rows and found.units >= units


CONTROLS = ["annual_temp_c", "annual_precip_mm"]


def assemble(heat: DataFrame, growth: DataFrame, controls: DataFrame | None, unit: str = "GID_2", lag: int = 0) -> DataFrame:
    """Heat with growth (``lag`` years on) and controls; terciles before rows without controls leave; the square of temperature.

    Without a table of controls their columns are there and NULL.  Years are named ``year``, or already ``year_heat`` and ``year_gdp``.
    """
    base = heat.withColumnRenamed("year", "year_heat") if "year" in heat.columns else heat
    panel = lead_join(base, growth.withColumnRenamed("year", "year_gdp") if "year" in growth.columns else growth, unit, lead=lag)
    panel = panel.na.drop(subset=["admin2_growth", "heat_freq_weighted"])
    if "gdp_per_capita" in panel.columns:
        panel = terciles(panel, unit, "gdp_per_capita", "income_tercile")
    if controls is None:
        return panel.withColumns({c: F.lit(None).cast("double") for c in [*CONTROLS, "annual_temp_c_sq"]})
    c = controls.select(unit, F.col("year").alias("year_heat"), *CONTROLS)
    panel = panel.join(c, [unit, "year_heat"], "left").na.drop(subset=CONTROLS)
    return panel.withColumn("annual_temp_c_sq", F.col("annual_temp_c") * F.col("annual_temp_c"))


def monotonic_steps(df: DataFrame, order: str, value: str, by: list[str] = ()) -> DataFrame:
    """``by..., monotonic``: whether the values, in order, never fall or never rise."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(order))
    steps = df.select(*by, step.alias("step"))
    never = F.coalesce(F.bool_and(F.col("step") >= 0) | F.bool_and(F.col("step") <= 0), F.lit(True)).alias("monotonic")
    return steps.groupBy(*by).agg(never) if by else steps.agg(never)
