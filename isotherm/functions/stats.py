"""Student t and F tails by the incomplete beta function's continued fraction."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz: even and odd terms alternate
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / (c or tiny)
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return math.nan
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def f_survival(f: float, d1: float, d2: float) -> float:
    if not (math.isfinite(f) and d1 > 0 and d2 > 0) or f < 0:
        return math.nan
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


#: terms of the continued fraction below: where the argument is near the turn between its two forms, beyond it, and on the short side
NEAR, FAR, SHORT = 160, 60, 40


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t as a column expression; NULL of NULL, NaN where ``t_two_sided`` has it.

    The incomplete beta function's continued fraction is taken from its last term up, so its state is one number.
    The ratio of gamma functions before it comes from a series far out and the recurrence down to df / 2.
    """
    a, t2 = df / 2, t * t
    x, y = df / (df + t2), t2 / (df + t2)
    up = a + 16
    series = 1 / (8 * up) - 1 / (192 * F.pow(up, F.lit(3))) + 1 / (640 * F.pow(up, F.lit(5))) - 17 / (14336 * F.pow(up, F.lit(7)))
    ratio = functools.reduce(lambda p, j: p * ((a + j) / (a + (j + 0.5))), range(16), F.exp(F.log(up) / 2 - series) / math.sqrt(math.pi))
    front = ratio * F.exp(-a * F.log1p(t2 / df)) * F.sqrt(y)
    far = x <= (a + 1) / (a + 2.5)
    state = F.struct(
        F.when(far, a).otherwise(0.5).alias("a"), F.when(far, 0.5).otherwise(a).alias("b"), F.when(far, x).otherwise(y).alias("x"), front.alias("front"), far.alias("far"),
        F.when(~far, F.lit(SHORT)).when(t2 < 7, F.lit(NEAR)).otherwise(F.lit(FAR)).alias("n"),
    )

    def value(p: Column) -> Column:
        def step(rest: Column, i: Column) -> Column:
            m = F.floor(i / 2)
            even = m * (p["b"] - m) / ((p["a"] + 2 * m - 1) * (p["a"] + 2 * m))
            odd = -(p["a"] + m) * (p["a"] + p["b"] + m) / ((p["a"] + 2 * m) * (p["a"] + 2 * m + 1))
            return F.when(i % 2 == 0, even).otherwise(odd) * p["x"] / (1 + rest)

        fraction = F.aggregate(F.sequence(p["n"], F.lit(1)), F.lit(0.0), step)
        part = p["front"] / p["a"] / (1 + fraction)
        return F.when(p["far"], part).otherwise(1 - part)

    # within an array of one, the fields are computed once and not for every term
    p = F.transform(F.array(state), value)[0]
    known = ~F.isnan(t) & (F.abs(t) < F.lit(math.inf)) & (df > 0)
    return F.when(t.isNull() | df.isNull(), F.lit(None).cast("double")).when(known, p).otherwise(F.lit(math.nan))
