"""Distributed quantiles against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import econometrics, panel
from isotherm.operators.quantiles import order_statistics, quantiles, Range

SHARES = [0, 0.1, 1 / 3, 0.5, 2 / 3, 0.9, 0.999, 1]


def table(spark, values, parts=5):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(parts)


@pytest.mark.parametrize("bins", [2, 7, 2048])
@pytest.mark.parametrize("kind", ["even", "ties", "skewed", "tiny", "wide", "one"])
def test_as_numpy(spark, kind, bins):
    g = np.random.default_rng(1)
    values = {
        "even": g.uniform(-5, 5, 3000), "ties": np.repeat([1.0, 2.0, 2.5, 7.0], [900, 1200, 1, 899]), "skewed": np.exp(g.normal(0, 6, 2500)),
        "tiny": np.array([5e-324, 1e-323, 1.5e-323, 0.0]), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, -3.0]), "one": np.array([3.25]),
    }[kind]
    got = quantiles(table(spark, values), "x", SHARES, bins=bins)
    with np.errstate(over="ignore"):
        want = [float(np.sort(values)[math.floor(p * (len(values) - 1))]) * (1 - p * (len(values) - 1) % 1) + float(np.sort(values)[math.ceil(p * (len(values) - 1))]) * (p * (len(values) - 1) % 1) for p in SHARES]
    assert got == pytest.approx(want, rel=1e-12, abs=0)


def test_missing_and_endless(spark):
    assert quantiles(table(spark, [None, math.nan]), "x", SHARES) is None
    got = quantiles(table(spark, [math.inf, 1, 2, None, -math.inf, math.nan, 3]), "x", [0, 0.25, 0.5, 0.75, 1])
    assert got == [-math.inf, 1, 2, 3, math.inf]


def test_distinct_values(spark):
    values = [1] * 500 + [2, 3, 4] + [9] * 300
    assert quantiles(table(spark, values), "x", [0, 1 / 4, 1 / 2, 1], distinct=True) == [1, 2, 3, 9]
    assert econometrics.spline_knots(table(spark, values), "x", 3) == [1, 3, 9]


def test_ties_over_edges(spark):
    """A value that fills several bins: equal edges count once, and all its rows are in one bin."""
    values = [1] * 40 + [5] * 400 + [6, 7, 8, 9] * 10
    df = table(spark, values)
    cut = panel.qcut(df, "x", 5, "bin", duplicates="drop").groupBy("x").agg(F.collect_set("bin").alias("b")).collect()
    assert all(len(r.b) == 1 for r in cut)
    edges = sorted(set(np.quantile(values, [i / 5 for i in range(6)])))
    want = {v: int(np.clip(np.searchsorted(edges, v, side="left"), 1, len(edges) - 1)) for v in set(values)}
    assert {int(r.x): r.b[0] for r in cut} == want
    with pytest.raises(ValueError, match="not unique"):
        panel.qcut(df, "x", 5, "bin")


def test_edge_between_close_values(spark):
    """Between values two last digits apart the edge lies between them, so the upper one is in the upper bin."""
    a, b = float.fromhex("0x1.f7268edab4c76p-2"), float.fromhex("0x1.f7268edab4c78p-2")
    df = table(spark, [0.1, a, b, 0.6, 0.7])
    assert a < quantiles(df, "x", [0.4])[0] < b
    assert {r.x: r.bin for r in panel.qcut(df, "x", 5, "bin").collect()} == {0.1: 1, a: 2, b: 3, 0.6: 4, 0.7: 5}


def test_no_task_holds_the_column(spark):
    """Each pass returns a bounded number of bins, and no plan has a percentile."""
    df = spark.range(200_000).select((F.col("id") * F.lit(0.37) % 1000).alias("v"))
    seen = []
    agg = type(df.groupBy("v")).agg

    def watched(self, *a):
        out = agg(self, *a)
        seen.append(out)
        return out

    type(df.groupBy("v")).agg = watched
    try:
        order_statistics(df, {0, 66_666, 66_667, 150_000}, Range(0.0, df.agg(F.max("v")).first()[0], 0, 200_000), bins=512)
    finally:
        type(df.groupBy("v")).agg = agg
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in seen]
    assert plans and not any("percentile" in p.lower() for p in plans) and all(x.count() <= 4 * 512 for x in seen if "cell" in x.columns)
