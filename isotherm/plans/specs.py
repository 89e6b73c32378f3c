"""The regression table: specifications over control sets, each a list of tidy rows."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.scalar import stars
from isotherm.operators.econometrics import Fit, detrend_quadratic, full_rank, spline_basis, spline_knots, wald, within_two_ways
from isotherm.operators.panel import dummies, lead_join, monotonic_steps, qcut
from isotherm.schemas import SCHEMAS, nan_to_null

CUTOFFS = (250.0, 500.0, 1000.0)
#: share of units with a place below which spatial errors come with a warning
COVERAGE = 0.9
Row = tuple


@dataclass
class Study:
    """A panel, the places of its units, and the names of its columns."""

    panel: DataFrame
    places: DataFrame
    y: str = "admin2_growth"
    heat: str = "heat_freq_weighted"
    controls: list[str] = field(default_factory=list)
    unit: str = "GID_2"
    year: str = "year_heat"
    country: str = "iso3"
    dof: str = "debiased"
    _held: list[DataFrame] = field(default_factory=list)
    _fits: dict[tuple, Fit] = field(default_factory=dict)

    def hold(self, df: DataFrame) -> DataFrame:
        """``df`` persisted until ``close``."""
        self._held.append(df.persist())
        return self._held[-1]

    def close(self) -> None:
        self._fits.clear()
        while self._held:
            self._held.pop().unpersist()

    def fit(self, x: list[str], panel: DataFrame | None = None, y: str | None = None, min_norm: bool = False) -> Fit:
        """Country trends out, rows with a gap out, columns that depend on others out, unit and year effects out, least squares; in this order.

        ``min_norm`` keeps all columns and takes the shortest coefficients.  A fit of the study's own panel is made once for all who ask for it.
        """
        y = y or self.y
        asked = (tuple(x), y, min_norm) if panel is None else None
        if asked in self._fits:
            return self._fits[asked]
        df = (self.panel if panel is None else panel).select(self.unit, self.year, self.country, y, *x)
        df = self.hold(detrend_quadratic(df, [y, *x], self.country, self.year).na.drop(subset=[y, *x]).drop(self.country))
        x = list(x) if min_norm else full_rank(df, x)
        out = Fit(self.hold(within_two_ways(df, [y, *x], self.unit, self.year)), y, x, self.unit, self.year, min_norm)
        if asked:
            self._fits[asked] = out
        return out

    def conley_rows(self, fit: Fit, spec: str, cutoffs: Sequence[float] = (500.0,), report: list[str] | None = None) -> list[Row]:
        out = []
        for cutoff, (v, n) in fit.conley(self.places, cutoffs).items():
            if n < COVERAGE * fit.n_units:
                warnings.warn(f"{spec}: only {n} of {fit.n_units} units have a place", stacklevel=2)
            out += fit.rows(spec, v, f"conley_{cutoff:.0f}", fit.n - fit.n_units - len(fit.x), report)
        return out


def baseline(s: Study) -> list[Row]:
    fit = s.fit([s.heat, *s.controls])
    return fit.rows("baseline", fit.covariance("unit", s.dof), "clustered_entity", report=[s.heat]) + s.conley_rows(fit, "baseline", report=[s.heat])


def standard_errors(s: Study) -> list[Row]:
    fit, out = s.fit([s.heat, *s.controls]), []
    for kind, name in (("unit", "clustered_entity"), ("time", "clustered_time"), ("two_way", "clustered_two_way"), ("kernel", "driscoll_kraay")):
        out += fit.rows("se_comparison", fit.covariance(kind, s.dof), name, report=[s.heat])
    return out + s.conley_rows(fit, "se_comparison", CUTOFFS, [s.heat])


def spline(s: Study, pieces: int = 4) -> list[Row]:
    names = [f"spline_{i + 1}" for i in range(pieces)]
    columns = spline_basis(F.col(s.heat).cast("double"), spline_knots(s.panel, s.heat, pieces))
    panel = s.panel.withColumns(dict(zip(names, columns, strict=True)))
    fit = s.fit([*names, *s.controls], panel)
    v = fit.covariance("unit", s.dof)
    out = fit.rows("spline", v, "clustered_entity", report=names)
    own = [i for i, x in enumerate(fit.x) if x in names]
    f, p = wald(fit.beta[own], v[np.ix_(own, own)], fit.n)
    out.append(("spline", s.y, "joint_wald", "clustered_entity", float("nan"), float("nan"), f, p, fit.r2, fit.n, fit.n_units))
    return out + s.conley_rows(s.fit([*names, *s.controls], panel, min_norm=True), "spline", report=names)


def turning_point(linear: float, square: float) -> float | None:
    return -linear / (2 * square) if square else None


def quadratic(s: Study) -> list[Row]:
    panel = s.panel.withColumn("heat_sq", F.col(s.heat) * F.col(s.heat))
    fit = s.fit([s.heat, "heat_sq", *s.controls], panel)
    out = fit.rows("quadratic", fit.covariance("unit", s.dof), "clustered_entity") + s.conley_rows(fit, "quadratic")
    b = dict(zip(fit.x, fit.beta, strict=True))
    point = turning_point(b.get(s.heat, 0.0), b.get("heat_sq", 0.0))
    if point is not None:
        out.append(("quadratic", s.y, "turning_point", "clustered_entity", float(point), float("nan"), float("nan"), float("nan"), fit.r2, fit.n, fit.n_units))
    return out


def bins(s: Study, n: int = 5) -> list[Row]:
    cut = dummies(qcut(s.panel, s.heat, n, "bin", duplicates="drop"), "bin", list(range(2, n + 1)), "bin_")
    names = [f"bin_{k}" for k in range(2, n + 1)]
    fit = s.fit([*names, *s.controls], cut)
    out = fit.rows("bins", fit.covariance("unit", s.dof), "clustered_entity", report=names) + s.conley_rows(fit, "bins", report=names)
    b = dict(zip(fit.x, fit.beta, strict=True))
    steps = s.panel.sparkSession.createDataFrame([(i, float(b[k])) for i, k in enumerate(names) if k in b], "i int, b double")
    nan = float("nan")
    return [*out, ("bins", s.y, "monotonic", "none", float(monotonic_steps(steps, "i", "b").first().monotonic), nan, nan, nan, fit.r2, fit.n, fit.n_units)]


def residual_outcome(s: Study, outcome: str = "residual") -> list[Row]:
    fit = s.fit([s.heat, *s.controls], s.panel.na.drop(subset=[outcome]), outcome)
    return fit.rows("residual_dv", fit.covariance("unit", s.dof), "clustered_entity", report=[s.heat]) + s.conley_rows(fit, "residual_dv", report=[s.heat])


def by_income(s: Study, column: str = "income_tercile", least_rows: int = 1000, least_units: int = 50) -> list[Row]:
    """Each tercile on its own, trends included; small ones are left out."""
    out = []
    for label in ("low", "mid", "high"):
        part = s.panel.where(F.col(column) == label)
        size = part.agg(F.count("*"), F.countDistinct(s.unit)).first()
        if size[0] < least_rows or size[1] < least_units:
            continue
        fit = s.fit([s.heat, *s.controls], part)
        out += fit.rows(f"income_{label}", fit.covariance("unit", s.dof), "clustered_entity", report=[s.heat]) + s.conley_rows(fit, f"income_{label}", report=[s.heat])
    return out


def lags(s: Study, heat: DataFrame, growth: DataFrame) -> list[Row]:
    """Growth of the same year, and of the next."""
    out = []
    for lead, spec in ((0, "contemporaneous"), (1, "lead_1")):
        panel = lead_join(heat, growth, s.unit, s.year, lead=lead).na.drop(subset=[s.y, s.heat, *s.controls])
        fit = s.fit([s.heat, *s.controls], panel)
        out += fit.rows(spec, fit.covariance("unit", s.dof), "clustered_entity", report=[s.heat]) + s.conley_rows(fit, spec, report=[s.heat])
    return out


SPECS: list[Callable[[Study], list[Row]]] = [baseline, standard_errors, spline, quadratic, bins, residual_outcome, by_income]


def tidy(spark: SparkSession, rows: list[Row]) -> DataFrame:
    """The rows as a table; what a row has no number for (errors of a turning point) is NULL, not NaN."""
    return nan_to_null(spark.createDataFrame([(*r[:9], int(r[9]), int(r[10])) for r in rows], SCHEMAS["results"]))


def regression_table(study: Study, control_sets: dict[str, list[str]], specs: list[Callable[[Study], list[Row]]] = SPECS, heat: DataFrame | None = None, growth: DataFrame | None = None) -> DataFrame:
    """Every specification under every control set, as the tidy table of results; what was held for it is released."""
    rows = []
    try:
        for name, controls in control_sets.items():
            study.controls = controls
            made = [r for spec in specs for r in spec(study)]
            if heat is not None and growth is not None:
                made += lags(study, heat, growth)
            rows += [(f"{name}_{r[0]}", *r[1:]) for r in made]
    finally:
        study.close()
    return tidy(study.panel.sparkSession, rows)


def report_lines(results: DataFrame) -> DataFrame:
    """The results as a reader wants them: numbers with fixed decimals, and the stars of their p-values."""
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(c), F.lit("")).otherwise(F.format_string("%+.5f", F.col(c)))
    return results.select("spec", "variable", "se_type", number("beta").alias("beta"), number("se").alias("se"), stars("pval").alias("stars"), "n_obs", "n_entities")
