"""Operators against hand-made tables and dense NumPy."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.functions import calendar, grid, percentile, scalar, stats
from isotherm.operators import econometrics as eco
from isotherm.operators import ensemble, exceedance, panel, zonal
from isotherm.schemas import nan_to_null
from isotherm.sources import tables


def test_nearest_rank_ties_and_missing(spark):
    rows = [(n, float(i)) for n in (1, 2, 10, 11, 31, 51) for i in range(n)] + [(99, None), (98, None), (98, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double").groupBy("g").agg(percentile.nearest_rank("v", 95).alias("p"))
    got = {r.g: r.p for r in df.collect()}
    assert got == {n: float(round(0.95 * (n - 1))) for n in (1, 2, 10, 11, 31, 51)} | {99: None, 98: 5.0}
    assert got[11] == 10.0 and got[31] == 28.0


def test_nan_becomes_null_and_exceeds_nothing(spark):
    df = nan_to_null(spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, 4.0)], "k int, v double"))
    hit = exceedance.exceeds(F.col("v"), F.lit(3.0))
    assert [r[0] for r in df.orderBy("k").select(hit).collect()] == [False, False, True]
    assert [r[0] for r in df.orderBy("k").select(exceedance.exceeds(F.col("v"), F.lit(3.0), True)).collect()] == [False, True, True]


def test_window_wraps_at_the_year_end(spark):
    days = [(y, d) for y, n in ((2001, 365), (2000, 366)) for d in range(1, n + 1)]
    df = calendar.pooled_days(spark.createDataFrame(days, "y int, doy int"), "doy")
    got = {(r.y, r.target_doy): r["count"] for r in df.groupBy("y", "target_doy").count().collect()}
    for target in (1, 5, 359):
        assert (got[2001, target], got[2000, target]) == (14, 15)
    for target in (60, 152, 335):
        assert (got[2001, target], got[2000, target]) == (15, 15)


def test_longitude_edges(spark):
    df = spark.createDataFrame([(0.0,), (179.9,), (180.0,), (179.99999,), (-180.0,)], "lon double")
    assert [r[0] for r in df.select(grid.lon_index("lon", 0.1)).collect()] == [1800, 3599, 0, 0, 0]
    assert [r[0] for r in df.select(grid.lon_index("lon", 0.1, edge="clip")).collect()] == [1800, 3599, 3599, 3599, 0]
    cells = spark.createDataFrame([(0, i, float(i)) for i in (3597, 3598, 3599, 0, 1)], "lat_i int, lon_i int, v double")
    wrap = {r.lon_i: r.v for r in zonal.coarsen(cells, "v").collect()}
    clip = {r.lon_i: r.v for r in zonal.coarsen(cells, "v", edge="clip").collect()}
    assert wrap[0] == pytest.approx((3599 + 0 + 1) / 3) and clip[1439] == pytest.approx((3597 + 3598 + 3599) / 3)


def test_season_policies_and_labels(spark):
    df = spark.createDataFrame([(2000, 12, 2001), (2001, 1, 2001), (2001, 2, 2001), (2002, 1, 2002)], "year int, month int, season_year int")
    kept = tables.complete_seasons(df, [12, 1, 2])
    assert {r.season_year for r in kept.collect()} == {2001}
    assert tables.complete_seasons(df, [12, 1, 2], policy="keep_partial").count() == 4


def test_frequency_counts_all_days(spark):
    days = spark.sql("select 1 as cell, d as date, case when day(d) <= 3 then 5.0 end as v from (select explode(sequence(date'2000-06-01', date'2000-06-10')) as d) union all select 2, date'2000-06-01', null")
    lim = spark.createDataFrame([(1, d, 4.0) for d in range(150, 170)], "cell int, doy int, threshold double")
    got = {r.cell: r.freq for r in exceedance.frequency(days, lim, ["cell"], "v", "date", [6], (2000, 2000)).collect()}
    assert got == {1: pytest.approx(0.3), 2: 0.0}
    got = {r.cell: r.freq for r in exceedance.frequency(days, lim, ["cell"], "v", "date", [6], (2000, 2000), nodata="null").collect()}
    assert got[2] is None


def test_zonal_masks(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, 3.0), (1, 9.0, 0.0), (1, None, 5.0), (2, 1.0, 0.0)], "unit int, v double, w double")
    row = zonal.weighted_zonal(df, ["unit"], "v", "w").collect()
    assert [(r.unit, r.weighted, r.plain, r.total_weight, r.n_cells) for r in row] == [(1, 3.5, 3.0, 4.0, 2)]


def test_mollweide_known_points(spark):
    r = 6378137.0
    df = spark.createDataFrame([(0.0, 0.0), (0.0, r * math.sqrt(2)), (2 * math.sqrt(2) * r, 0.0), (9e7, 0.0)], "x double, y double")
    lat, lon = grid.mollweide_inverse("x", "y")
    got = [tuple(x) for x in df.select(F.round(lat, 6), F.round(lon, 6)).collect()]
    assert got[0] == (0.0, 0.0) and got[1][0] == pytest.approx(90) and got[2] == (0.0, 180.0) and got[3][1] is None


def test_growth_bins_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, math.e), ("a", 4, 0.0), ("b", 1, 3.0)], "u string, y int, v double")
    got = {(r.u, r.y): r.growth for r in panel.log_growth(df, "u", "y", "v").collect()}
    assert got["a", 2] == pytest.approx(1) and got["a", 1] is None and got["a", 4] is None and got["b", 1] is None
    x = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 2, 3, 4, 5)], "v double")
    assert [r.bin for r in panel.qcut(x, "v", 5, "bin", "drop").orderBy("v").collect()] == [1, 1, 1, 2, 3, 4, 4]  # edges 1, 1.4, 2.6, 3.8, 5
    with pytest.raises(Exception, match="not unique"):
        panel.qcut(x, "v", 5, "bin").collect()


def unbalanced(seed=1, units=40, years=12):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(units):
        for t in range(years):
            if g.random() > 0.3:
                x1, x2 = g.normal(), g.normal()
                rows.append((f"u{i}", 2000 + t, f"c{i % 5}", float(0.5 * x1 - x2 + i + 0.1 * t * (i % 5) + g.normal()), float(x1), float(x2)))
    return rows


def dense(rows):
    units, years = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    d = np.array([[r[0] == u for u in units] + [r[1] == t for t in years] for r in rows], dtype=float)
    z = np.array([r[3:6] for r in rows])
    return z - d @ np.linalg.lstsq(d, z, rcond=None)[0], units, years


def test_within_ols_and_covariances_match_dense(spark):
    rows = unbalanced()
    df = spark.createDataFrame(rows, "unit string, year int, country string, y double, x1 double, x2 double")
    w = eco.within_two_ways(df, ["y", "x1", "x2"], "unit", "year").persist()
    z, units, years = dense(rows)
    got = {(r.unit, r.year): (r.y, r.x1, r.x2) for r in w.collect()}
    assert np.allclose([got[r[0], r[1]] for r in rows], z, atol=1e-9)
    fit = eco.Fit(w, "y", ["x1", "x2"], "unit", "year")
    x, y = z[:, 1:], z[:, 0]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(fit.beta, beta)
    s, inv = x * (y - x @ beta)[:, None], np.linalg.inv(x.T @ x)
    summed = lambda k: np.array([s[[r[k] == v for r in rows]].sum(0) for v in (units, years)[k]])
    outer = lambda a: a.T @ a
    meat = {"unit": outer(summed(0)), "time": outer(summed(1)), "two_way": outer(summed(0)) + outer(summed(1)) - outer(s), "robust": outer(s)}
    h = summed(1)
    meat["kernel"] = outer(h) + sum((1 - j / 6) * (h[j:].T @ h[:-j] + h[:-j].T @ h[j:]) for j in range(1, 6))
    for kind, m in meat.items():
        assert np.allclose(fit.covariance(kind, dof="none"), inv @ m @ inv, atol=1e-10), kind


def test_conley_matches_brute_force(spark):
    rows = unbalanced(2)
    g = np.random.default_rng(3)
    places = [(f"u{i}", float(g.uniform(-60, 60)), float(g.uniform(-180, 180))) for i in range(40)]
    w = eco.within_two_ways(spark.createDataFrame(rows, "unit string, year int, country string, y double, x1 double, x2 double"), ["y", "x1", "x2"], "unit", "year").persist()
    fit = eco.Fit(w, "y", ["x1", "x2"], "unit", "year")
    placed = spark.createDataFrame([*places, ("nowhere", 1.0, 1.0), ("u0x", None, 2.0)], "id string, lat double, lon double")
    found = fit.conley(placed, [500.0, 3000.0], key="id", dense=3)  # cubes in several parts
    v, n = found[3000.0]
    z, units, _ = dense(rows)
    s = z[:, 1:] * (z[:, 0] - z[:, 1:] @ fit.beta)[:, None]
    e = np.array([s[[r[0] == u for r in rows]].sum(0) for u in units])
    at = {p[0]: np.radians(p[1:]) for p in places}
    xyz = np.array([[math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)] for a, o in (at[u] for u in units)])
    km = 2 * 6371 * np.arcsin(np.minimum(1, np.linalg.norm(xyz[:, None] - xyz[None], axis=2) / 2))
    k = np.clip(1 - km / 3000, 0, 1)
    inv = np.linalg.inv(z[:, 1:].T @ z[:, 1:])
    assert n == 40 and np.allclose(v, inv @ (e.T @ k @ e) @ inv * 40 / 39, atol=1e-10)
    assert np.allclose(found[500.0][0], inv @ (e.T @ np.clip(1 - km / 500, 0, 1) @ e) @ inv * 40 / 39, atol=1e-10)
    sub = {p[0] for p in places[:30]}
    v, n = fit.conley(placed.where(F.col("id").isin(list(sub))), [3000.0], key="id")[3000.0]
    own = [i for i, u in enumerate(units) if u in sub]
    assert n == 30 and np.allclose(v, inv @ (e[own].T @ k[np.ix_(own, own)] @ e[own]) @ inv * 30 / 29, atol=1e-10)


def test_pairs_at_poles_and_date_line(spark):
    pts = [(0, 89.9, 0.0), (1, 89.9, 180.0), (2, 0.0, 179.9), (3, 0.0, -179.9), (4, 0.0, 0.0), (5, 0.0, 0.0)]
    got = {(r.i, r.j): r.km for r in eco.distance_pairs(spark.createDataFrame(pts, "id int, lat double, lon double"), 100.0).where("i <> j").collect()}
    assert set(got) == {(0, 1), (2, 3), (4, 5)} and got[4, 5] == 0 and got[2, 3] == pytest.approx(22.24, abs=0.01)


def test_pairs_are_met_once(spark):
    """All pairs within the cutoff against a plain loop, whatever cubes they fall into and however these are dealt."""
    g = np.random.default_rng(9)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(np.degrees(np.arcsin(g.uniform(-1, 1, 150))), g.uniform(-180, 180, 150), strict=True))] + [(200 + i, 10.0, 20.0 + i / 100) for i in range(40)]
    xyz = np.array([[math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))] for _, a, o in pts])
    km = 2 * 6371 * np.arcsin(np.minimum(1, np.linalg.norm(xyz[:, None] - xyz[None], axis=2) / 2))
    want = sorted((pts[i][0], pts[j][0]) for i in range(len(pts)) for j in range(i, len(pts)) if km[i, j] <= 2500)
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    for dense in (7, 4096):
        got = eco.distance_pairs(df, 2500.0, dense=dense).collect()
        assert sorted((r.i, r.j) for r in got) == want


def test_pairs_are_spread_over_tasks(spark, tmp_path):
    """A small file's pairs are not one task's: of points all around, and of one cube that is dealt into parts."""
    around = [(i, float(i * 37 % 180 - 90), float(i * 101 % 360 - 180)) for i in range(400)]
    spot = [(i, 10.0, 20.0 + i / 1000) for i in range(200)]
    for name, pts, dense in (("around", around, 4096), ("spot", spot, 8)):
        spark.createDataFrame(pts, "id int, lat double, lon double").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        pairs = eco.distance_pairs(spark.read.parquet(f"{tmp_path}/{name}"), 2500.0, dense=dense)
        made = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert len(made) == 4 and max(made) < sum(made) / 2, (name, made)
        assert name == "around" or sum(made) == 200 * 201 // 2


def test_detrend_matches_least_squares(spark):
    rows = unbalanced(4) + [("z", 2003, "small", 1.0, 2.0, 3.0), ("z", 2004, "small", 2.0, 2.0, 3.0), ("n", 2001, None, 1.0, 1.0, 1.0)]
    rows += [("p", 2005, "one_year", float(i), 0.0, 0.0) for i in range(5)]
    out = eco.detrend_quadratic(spark.createDataFrame(rows, "unit string, year int, country string, y double, x1 double, x2 double"), ["y", "x1"], "country", "year").collect()
    for c in sorted({r[2] for r in rows if r[2]}):
        own = sorted(r for r in rows if r[2] == c)
        t = np.array([r[1] - 2000 for r in own], dtype=float)
        y = np.array([r[3] for r in own])
        d = np.stack([t**0, t, t * t], axis=1)
        want = y if len(own) < 4 else y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
        got = [r.y for r in sorted((r for r in out if r.country == c), key=lambda r: tuple(x if x is not None else 0 for x in (r.unit, r.year)))]
        assert np.allclose(sorted(got), sorted(want), atol=1e-8), c
    assert [r.y for r in out if r.country is None] == [None]


def test_spline_rows_add_up_and_hit_knots(spark):
    knots = [0.0, 1.0, 3.0, 4.0]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 3.5, 4.0, 6.0)], "x double")
    got = np.array([tuple(r) for r in df.select(*eco.spline_basis(F.col("x"), knots)).collect()])
    assert np.allclose(got.sum(1), 1)
    assert np.allclose(got[[1, 3, 5, 7]], np.eye(4), atol=1e-12)


def test_rank_deficient_columns_leave():
    g = np.random.default_rng(0)
    x = g.normal(size=(50, 3))
    z = np.column_stack([x[:, 0], x[:, 1], x[:, 0] - 2 * x[:, 1], x[:, 2]])
    assert eco.independent(z.T @ z, ["a", "b", "c", "d"]) == ["a", "b", "d"]


def dense_rank(z):
    """Columns kept by a dense QR with pivoting, one projection after the other."""
    left, order, diagonal = z.copy(), [], []
    for _ in range(z.shape[1]):
        size = np.linalg.norm(left, axis=0)
        size[order] = -1
        j = int(np.argmax(size))
        order.append(j)
        diagonal.append(max(size[j], 0))
        if size[j] > 0:
            q = left[:, j] / size[j]
            left = left - np.outer(q, q @ left)
    keep = np.array(diagonal) > max(z.shape) * diagonal[0] * np.finfo(float).eps * 100
    return sorted(np.array(order)[keep].tolist())


@pytest.mark.parametrize("noise", [0, 1e-15, 1e-9, 1e-6])
def test_rank_by_merged_factors(spark, noise):
    """Columns that are nearly or wholly combinations of others are decided as by a dense QR; a Gram matrix would square the condition."""
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 3)) * [3.0, 1.0, 0.01]
    z = np.column_stack([x[:, 0], x[:, 1], x[:, 0] - 2 * x[:, 1] + noise * g.normal(size=400), x[:, 2], np.zeros(400)])
    names = list("abcde")
    df = spark.createDataFrame([tuple(map(float, r)) for r in z], ", ".join(f"{n} double" for n in names)).repartition(7)
    r, n = eco.r_factor(df, names)
    assert n == 400 and np.allclose(r.T @ r, z.T @ z, atol=1e-9)
    diagonal, order = eco.pivoted(r)
    dense = eco.pivoted(np.linalg.qr(z, mode="r"))
    assert np.allclose(diagonal[:3], dense[0][:3]) and order[:3] == dense[1][:3]
    assert eco.full_rank(df, names) == [names[i] for i in dense_rank(z)]
    assert len(eco.full_rank(df, names)) == (3 if noise < 1e-12 else 4) and eco.full_rank(df, ["e"]) == ["e"]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")  # a tree of two more levels
    tree = eco.r_factor(df, names)[0]
    assert np.allclose(tree.T @ tree, z.T @ z, atol=1e-9) and np.allclose(eco.pivoted(tree)[0][:3], diagonal[:3])
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_averages_leave_missing_pixels_out(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2000, 4.0), (10.0, 10.0, 2000, None), (20.0, 20.0, 2000, float("nan")), (3e6, 0.0, 2000, None)], "x double, y double, epoch int, value double")
    assert sorted(r.built_surface for r in zonal.reproject_built(df, step=1.0).collect()) == [0.0, 4.0]


def test_tails():
    assert stats.t_two_sided(2.100922, 18) == pytest.approx(0.05, abs=1e-7)
    assert stats.t_two_sided(0.0, 4) == pytest.approx(1)
    assert stats.f_survival(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert math.isnan(stats.t_two_sided(math.nan, 3)) and math.isnan(stats.f_survival(-1.0, 2, 3))


def test_tail_as_an_expression(spark):
    rows = [(float(t), float(df)) for df in (1, 2, 3, 7, 22, 23, 100, 1000, 10**6) for t in (0, 1e-3, 0.3, 1, 1.7, 1.74, 1.9, 2.5, 3.1, -6, 38)] + [(math.nan, 3.0), (math.inf, 3.0), (1.0, 0.0), (None, 3.0), (1.0, None)]
    df = spark.createDataFrame(rows, "t double, df double")
    got = [r[0] for r in df.select(stats.t_tail(F.col("t"), F.col("df"))).collect()]
    for (t, n), p in zip(rows, got, strict=True):
        if t is None or n is None:
            assert p is None
        elif not math.isfinite(t) or n <= 0:
            assert math.isnan(p)
        else:
            assert p == pytest.approx(stats.t_two_sided(t, n), rel=1e-11 * max(1, n / 100))


def test_pointwise_fit_and_tail_sizes(spark):
    g = np.random.default_rng(5)
    x, y = g.normal(size=30), g.normal(size=30)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, 1.0, 1.0), (1, None, 2.0)], "cell int, x double, y double")
    r = {r.cell: r for r in ensemble.pointwise_ols(df, ["cell"], "x", "y").collect()}
    b = np.polyfit(x, y, 1)
    e = y - np.polyval(b, x)
    assert r[1].slope == pytest.approx(b[0]) and r[1].stderr == pytest.approx(math.sqrt(e @ e / 28 / ((x - x.mean()) ** 2).sum())) and 2 not in r
    v = spark.createDataFrame([(n, float(i) ** 1.5) for n in (180, 181, 400) for i in range(n)] + [(7, None)], "cell int, v double")
    t = {r.cell: r for r in ensemble.tail_slope(v, ["cell"], "v").collect()}
    assert (t[180].n_tail, t[180].slope, t[181].n_tail) == (9, None, 10) and t[181].slope > 0


def test_probability_floor_and_winters(spark):
    m = spark.sql("select 1 as cell, 2000 as hDate, date'2000-12-31' as inidate, n as number, cast(n as float) as value from (select explode(sequence(1, 4)) as n)")
    lim = spark.createDataFrame([(1, 365, 100.0)], "cell int, dayofyear int, thresh double")
    a = ensemble.exceedance_probability(m, lim, ["cell"], ["hDate"], "value", "inidate", last_day=365).first()
    b = ensemble.exceedance_probability(m, lim, ["cell"], ["hDate"], "value", "inidate", last_day=365, floor=True).first()
    assert (a.prob, a.log_prob) == (0.0, None) and b.log_prob == pytest.approx(math.log(0.25))
    assert ensemble.assemble_djf(m).select("hDate").distinct().collect()[0][0] == 2001


def test_smoothing_keeps_constants_and_gaps(spark):
    rows = [(0, a, o, 2.0) for a in range(19) for o in range(36)]
    df = spark.createDataFrame(rows, "t int, lat_i int, lon_i int, v double")
    got = ensemble.smooth(df, "v", ["t"], 10.0, 19, 36, radius_km=800.0)
    assert all(r.v == pytest.approx(2.0) for r in got.collect()) and got.count() == len(rows)
    assert ensemble.smooth(df.where("lat_i <> 9"), "v", ["t"], 10.0, 19, 36, radius_km=800.0).where("lat_i = 9").count() == 0


def test_mirrored_smoothing_matches_numpy(spark):
    g = np.random.default_rng(6)
    n, m, sigma = 7, 9, 1.5
    z = g.normal(size=(n, m))
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    want = z
    for axis in (0, 1):
        want = np.apply_along_axis(lambda v: np.convolve(np.pad(v, reach, mode="symmetric"), w, mode="valid"), axis, want)
    df = spark.createDataFrame([(0, i, j, float(z[i, j])) for i in range(n) for j in range(m)], "t int, lat_i int, lon_i int, v double")
    got = {(r.lat_i, r.lon_i): r.v for r in ensemble.smooth_isotropic(df, "v", ["t"], sigma, n, m).collect()}
    assert np.allclose([[got[i, j] for j in range(m)] for i in range(n)], want)


def test_range_check_fails(spark):
    df = spark.createDataFrame([(0.5,), (None,)], "v double")
    assert panel.check_range(df, "v").count() == 2
    with pytest.raises(Exception, match="out of range"):
        panel.check_range(spark.createDataFrame([(1.5,)], "v double"), "v").collect()


def test_stages_resume_and_reports(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, 0.123456789, None)], "k int, a double, b double")

    path = str(tmp_path / "stage")
    tables.built_once(spark, path, build)
    tables.built_once(spark, path, build)
    assert len(calls) == 1
    assert [tuple(r) for r in tables.fixed_decimals(spark.read.parquet(path)).collect()] == [(1, "0.12345679", None)]
    tables.write_partitioned(spark.createDataFrame([(1, 2000), (2, 2001)], "k int, year int"), str(tmp_path / "p"), ["year"])
    tables.write_partitioned(spark.createDataFrame([(3, 2001)], "k int, year int"), str(tmp_path / "p"), ["year"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 3]


def test_epochs_and_stars(spark):
    years = [2000, 2002, 2003, 2007, 2008, 2012, 2013, 2017, 2018, 2022, 2023, 2030]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    assert [r[0] for r in df.select(zonal.epoch_of(F.col("y"))).collect()] == [2000, 2000, 2005, 2005, 2010, 2010, 2015, 2015, 2020, 2020, 2025, 2025]
    p = spark.createDataFrame([(0.0005,), (0.001,), (0.01,), (0.05,), (0.1,), (None,)], "p double")
    assert [r[0] for r in p.select(scalar.stars("p")).collect()] == ["***", "**", "*", "+", "", ""]


@pytest.mark.parametrize("kind", ["float", "double", "long"])
@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_thresholds_are_those_of_exploded_windows(spark, kind, method):
    """Cell by cell on a circle of days, and value by value on exploded windows: ties, nulls, a null cell, days at the year's ends."""
    days = spark.sql("select explode(sequence(date'1999-12-01', date'2002-02-10')) as date").where("month(date) in (12, 1, 2)")
    cells = spark.createDataFrame([(0, 1), (1, 1), (2, None)], "lat_i int, lon_i int")
    value = F.when(F.pmod(F.xxhash64("lat_i", "date"), F.lit(9)) > 0, F.pmod(F.xxhash64("date", "lat_i"), F.lit(40)))
    daily = cells.join(days).withColumn("v", value.cast(kind))
    args = (["lat_i", "lon_i"], "v", "date", (1999, 2002), [12, 1, 2], [1, 2])
    got = exceedance.thresholds(daily, *args, method=method)
    base = daily.where("v is not null").withColumn("doy", F.dayofyear("date"))
    pooled = calendar.pooled_days(base, "doy").where("target_doy <= 60").groupBy("lat_i", "lon_i", F.col("target_doy").alias("doy"))
    want = pooled.agg(percentile.METHODS[method]("v", 95).alias("threshold"))
    assert got.columns == want.columns and got.schema["threshold"].dataType == want.schema["threshold"].dataType
    seen = {r[0] for r in base.where("month(date) < 3").select("doy").distinct().collect()}
    table = lambda df: sorted(((r.lat_i, r.lon_i, r.doy, round(float(r.threshold), 9)) for r in df.collect() if r.doy in seen), key=repr)
    assert table(got) == table(want) and len(table(got)) > 100
    assert exceedance.thresholds(daily.where("false"), *args, method=method).count() == 0


def test_places_from_the_environment(monkeypatch):
    from isotherm.config import Config

    assert Config().table("x") == "data/output/x"
    monkeypatch.setenv("ISOTHERM_OUTPUT", "/elsewhere")
    assert Config().table("x") == "/elsewhere/x" and Config(output="/own").table("x") == "/own/x"


def test_reports_attributes_and_sketches(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5, None), (1, float("nan"), 1 / 3)], "k int, a double, b double")
    tables.write_report(tables.sorted_panel(df, "k"), f"{tmp_path}/r")
    (part,) = tmp_path.glob("r/part-*.csv")
    assert part.read_text().splitlines() == ["k,a,b", "1,,0.33333333", "2,0.50000000,"]
    tables.described(df, "a", units="mm").write.parquet(f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").schema["a"].metadata == {"units": "mm"}
    back = tables.read_table(spark, f"{tmp_path}/p", columns=["k", "a"])
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, 0.5)]
    values = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    assert abs(values.agg(percentile.approximate("v", 95).alias("p")).first().p - 9500) <= 2


def test_tail_size_does_not_hang_on_the_order_of_rows(spark):
    """Rows come in another order each time they are read, as they do from a shuffle; the cut is one of five copies of the greatest value."""

    def in_any_order(frames):
        for f in frames:
            yield f.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "big"))

    rows = [(cell, (i % 20 + cell / 7) / 3) for cell in range(40) for i in range(100)]
    df = spark.createDataFrame(rows, "cell int, v double").coalesce(1).mapInPandas(in_any_order, "cell int, v double")
    held = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        sizes = [r.n_tail for r in ensemble.tail_slope(df, ["cell"], "v", percent=96.0).collect()]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", held)
    assert sizes == [5] * 40


def test_kernel_sums_of_blocks_match_brute_force(spark):
    """Poles, date line and crowded cubes; blocks of a few points."""
    g = np.random.default_rng(3)
    lat = np.r_[g.uniform(85, 90, 40), g.uniform(-3, 3, 60), -90.0]
    lon = np.r_[g.uniform(-180, 180, 40), g.choice([-1, 1], 60) * g.uniform(176, 180, 60), 0.0]
    v = g.normal(size=(101, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(s), float(t)) for i, (a, b, (s, t)) in enumerate(zip(lat, lon, v, strict=True))], "k int, lat double, lon double, s double, t double")
    points = df.select("k", *[c.alias(n) for c, n in zip(scalar.unit_xyz("lat", "lon"), "xyz", strict=True)], "s", "t")
    phi, lam = np.radians(lat), np.radians(lon)
    xyz = np.c_[np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)]
    km = 2 * 6371.0 * np.arcsin(np.minimum(np.linalg.norm(xyz[:, None] - xyz[None], axis=2) / 2, 1))
    for dense in (4, 1000):
        sums, n = eco.kernel_sums(points, ["s", "t"], [200.0, 500.0], dense)
        assert n == 101
        for c, m in zip((200.0, 500.0), sums, strict=True):
            assert np.allclose(m, v.T @ np.clip(1 - km / c, 0, 1) @ v, rtol=1e-9, atol=1e-9)
    none = eco.kernel_sums(points.where("k < 0"), ["s", "t"], [200.0])
    assert none[1] == 0 and not none[0][0].any()
