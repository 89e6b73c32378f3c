"""Specifications of the regression table against dense least squares."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.functions.stats import f_survival, t_two_sided
from isotherm.plans import catalog, specs

UNITS, YEARS = 45, 14


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(11)
    out = []
    for i in range(UNITS):
        for t in range(YEARS):
            if g.random() > 0.25:
                heat = round(float(g.beta(2, 5)), 2)  # ties
                out.append((f"u{i:02d}", 2000 + t, f"c{i % 4}", float(0.3 * heat - 2 * heat**2 + 0.05 * i + 0.02 * t * (i % 4) + g.normal(0, 0.2)), heat, float(g.normal()), ("low", "mid", "high")[i % 3]))
    return out


@pytest.fixture(scope="module")
def places():
    g = np.random.default_rng(12)
    return [(f"u{i:02d}", float(g.uniform(40, 50)), float(g.uniform(0, 12))) for i in range(UNITS - 1)]  # the last unit has no place


@pytest.fixture
def study(spark, rows, places):
    df = spark.createDataFrame(rows, "unit string, year int, country string, y double, heat double, x2 double, income_tercile string")
    out = specs.Study(df, spark.createDataFrame(places, "unit string, lat double, lon double"), y="y", heat="heat", controls=["x2"], unit="unit", year="year", country="country")
    out.panel, out.places = out.hold(out.panel), out.hold(out.places)
    yield out
    out.close()


class Dense:
    """Trends out, dependent columns out, effects out, least squares, clustered and spatial errors; all by dense matrices."""

    def __init__(self, rows, names, columns, places, cutoff=500.0, min_norm=False):
        self.units, years = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        z = np.column_stack([[r[3] for r in rows], *columns]).astype(float)
        t = np.array([r[1] for r in rows], dtype=float) - min(years)
        for c in {r[2] for r in rows}:
            own = np.array([r[2] == c for r in rows])
            d = np.stack([t[own] ** 0, t[own], t[own] ** 2], axis=1)
            z[own] -= d @ np.linalg.lstsq(d, z[own], rcond=None)[0]
        if not min_norm:
            left, order, size = z[:, 1:].copy(), [], []
            for _ in names:
                n = np.linalg.norm(left, axis=0)
                n[order] = -1
                order.append(int(np.flatnonzero(n >= n.max() * (1 - 1e-8))[0]))  # two equal ones: the first
                size.append(n[order[-1]])
                q = left[:, order[-1]] / max(size[-1], 1e-300)
                left = left - np.outer(q, q @ left)
            keep = sorted(j for j, s in zip(order, size, strict=True) if s > max(z.shape) * size[0] * np.finfo(float).eps * 100)
            names, z = [names[j] for j in keep], z[:, [0, *[j + 1 for j in keep]]]
        self.names = names
        d = np.array([[r[0] == u for u in self.units] + [r[1] == y for y in years] for r in rows], dtype=float)
        z -= d @ np.linalg.lstsq(d, z, rcond=None)[0]
        x, y = z[:, 1:], z[:, 0]
        self.n, k = x.shape
        inv = np.linalg.pinv(x.T @ x, rcond=1e-12)
        self.beta = inv @ x.T @ y
        e = y - x @ self.beta
        self.r2 = 1 - e @ e / (y @ y)
        s = x * e[:, None]
        by = np.array([s[[r[0] == u for r in rows]].sum(0) for u in self.units])
        absorbed = len(self.units) + len(years) - 1
        self.df = self.n - k - absorbed
        self.unit = inv @ (by.T @ by) @ inv * self.n / self.df
        at = {p[0]: np.radians(p[1:]) for p in places}
        placed = [i for i, u in enumerate(self.units) if u in at]
        xyz = np.array([[math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)] for a, o in (at[self.units[i]] for i in placed)])
        km = 2 * 6371 * np.arcsin(np.minimum(1, np.linalg.norm(xyz[:, None] - xyz[None], axis=2) / 2))
        b = by[placed]
        self.conley = inv @ (b.T @ np.clip(1 - km / cutoff, 0, 1) @ b) @ inv * len(placed) / (len(placed) - 1)
        self.conley_df = self.n - len(self.units) - k


def same(row, name, beta, v, df, dense):
    se = math.sqrt(v)
    assert (row[2], row[9], row[10]) == (name, dense.n, len(dense.units))
    assert row[4] == pytest.approx(beta, rel=1e-6, abs=1e-9) and row[5] == pytest.approx(se, rel=1e-6) and row[6] == pytest.approx(beta / se, rel=1e-6, abs=1e-9)
    assert row[7] == pytest.approx(t_two_sided(beta / se, df), rel=1e-5) and row[8] == pytest.approx(dense.r2, rel=1e-6)


def held_against(found, dense, report, spatial=None):
    spatial = spatial or dense
    clustered = {r[2]: r for r in found if r[3] == "clustered_entity" and r[2] in report}
    conley = {r[2]: r for r in found if r[3].startswith("conley")}
    assert list(clustered) == [n for n in dense.names if n in report] and list(conley) == [n for n in spatial.names if n in report]
    for i, n in enumerate(dense.names):
        if n in report:
            same(clustered[n], n, dense.beta[i], dense.unit[i, i], dense.df, dense)
    for i, n in enumerate(spatial.names):
        if n in report:
            same(conley[n], n, spatial.beta[i], spatial.conley[i, i], spatial.conley_df, spatial)


def natural_spline(x, knots):
    """Cardinal natural cubic spline, by truncated powers that are linear beyond the ends."""
    d = lambda v, k: (np.maximum(v - knots[k], 0) ** 3 - np.maximum(v - knots[-1], 0) ** 3) / (knots[-1] - knots[k])
    basis = lambda v: np.column_stack([np.ones_like(v), v, *[d(v, k) - d(v, len(knots) - 2) for k in range(len(knots) - 2)]])
    return basis(x) @ np.linalg.inv(basis(knots))


def test_spline(study, rows, places):
    """The basis adds up to 1: the column that a QR with pivoting has last is left out, but not of the spatial errors, which take the shortest coefficients."""
    heat = np.array([r[4] for r in rows])
    knots = np.quantile(np.unique(heat), [0, 1 / 3, 2 / 3, 1])
    names = [f"spline_{i + 1}" for i in range(4)]
    columns = [*natural_spline(heat, knots).T, [r[5] for r in rows]]
    dense, whole = (Dense(rows, [*names, "x2"], columns, places, min_norm=m) for m in (False, True))
    assert len(dense.names) == 4 and "x2" in dense.names
    found = specs.spline(study)
    held_against([r for r in found if r[2] in names], dense, names, whole)
    own = [i for i, n in enumerate(dense.names) if n in names]
    b, v = dense.beta[own], dense.unit[np.ix_(own, own)]
    f = b @ np.linalg.inv(v) @ b / len(own)
    (wald,) = [r for r in found if r[2] == "joint_wald"]
    assert math.isnan(wald[4]) and math.isnan(wald[5]) and wald[6] == pytest.approx(f, rel=1e-6) and wald[7] == pytest.approx(f_survival(f, len(own), dense.n - len(own)), rel=1e-5)


def test_quadratic(study, rows, places):
    heat = np.array([r[4] for r in rows])
    dense = Dense(rows, ["heat", "heat_sq", "x2"], [heat, heat**2, [r[5] for r in rows]], places)
    found = specs.quadratic(study)
    held_against([r for r in found if r[2] != "turning_point"], dense, dense.names)
    (point,) = [r for r in found if r[2] == "turning_point"]
    assert point[3] == "clustered_entity" and point[4] == pytest.approx(-dense.beta[0] / (2 * dense.beta[1]), rel=1e-6)
    assert specs.turning_point(1.0, 0.0) is None


def test_bins_with_ties(study, rows, places):
    heat = np.array([r[4] for r in rows])
    edges = np.quantile(heat, [0.2, 0.4, 0.6, 0.8])
    bins = 1 + (heat[:, None] > edges[None]).sum(1)
    names = [f"bin_{k}" for k in range(2, 6)]
    dense = Dense(rows, [*names, "x2"], [*[(bins == k).astype(float) for k in range(2, 6)], [r[5] for r in rows]], places)
    found = specs.bins(study)
    held_against([r for r in found if r[2] != "monotonic"], dense, names)
    steps = np.diff(dense.beta[:4])
    assert [r[4] for r in found if r[2] == "monotonic"] == [float((steps >= 0).all() or (steps <= 0).all())]


def test_terciles(study, rows, places):
    """Each part on its own; parts of too few rows or units are left out."""
    found = specs.by_income(study, least_rows=100, least_units=10)
    for label in ("low", "mid", "high"):
        own = [r for r in rows if r[6] == label]
        dense = Dense(own, ["heat", "x2"], [[r[4] for r in own], [r[5] for r in own]], places)
        held_against([r for r in found if r[0] == f"income_{label}"], dense, ["heat"])
    assert specs.by_income(study, least_rows=10_000) == [] and specs.by_income(study, least_rows=1, least_units=50) == []


def test_few_places_are_said(spark, study, places):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        specs.baseline(study)
    study.places = study.places.where(F.col("unit") < "u30")
    with pytest.warns(UserWarning, match="30 of 45 units"):
        specs.baseline(study)


def test_a_fit_of_the_own_panel_is_made_once(study):
    first = study.fit(["heat", "x2"])
    assert study.fit(["heat", "x2"]) is first and study.fit(["heat"]) is not first
    assert study.fit(["heat", "x2"], study.panel.where("x2 > 0")) is not first
    study.close()
    assert not study._fits


def test_what_a_row_lacks_is_null_in_the_table(spark):
    """As in the SQL of regression_shapes, where a turning point has null errors; NaN would count as a number."""
    nan = math.nan
    rows = [("bins", "y", "monotonic", "none", 1.0, nan, nan, nan, 0.5, 10, 2), ("bins", "y", "bin_2", "clustered_entity", 0.25, 0.5, 0.5, 0.62, 0.5, 10, 2)]
    found = catalog._tidy(specs.tidy(spark, rows))
    assert [tuple(r)[4:] for r in found.orderBy("beta").collect()] == [(0.25, 0.5, 0.5, 0.62, 0.5, 10, 2), (1.0, None, None, None, 0.5, 10, 2)]
    assert found.where("isnan(se) or isnan(tstat) or isnan(pval)").count() == 0
