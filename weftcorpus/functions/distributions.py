"""Tails and quantiles of Student's t and Fisher's F as column expressions.

They rest on the regularised incomplete beta function, by its continued fraction
(modified Lentz) in a fold over a fixed number of steps; quantiles invert it by
bisection. Fit for tables of results: a row costs some thousand steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 300
# The Lanczos coefficients for g = 7 and nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x >= 0.5; by its series in 1/x where that is the more exact one."""

    def of(x):
        y = x - 1
        total = F.lit(_LANCZOS[0])
        for i, c in enumerate(_LANCZOS[1:], 1):
            total = total + F.lit(c) / (y + i)
        small = 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(y + 7.5) - (y + 7.5) + F.log(total)
        large = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
        return F.when(x < 20, small).otherwise(large)

    return _let(x, of)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """1 + n1 / (1 + n2 / (1 + ...)), for x up to (a + 1) / (a + b + 2)."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(s, i):
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(s["settled"], s).otherwise(_let(F.when(i % 2 == 0, even).otherwise(odd), lambda n: _let(F.struct((1 / safe(1 + n * s["d"])).alias("d"), safe(1 + n / s["c"]).alias("c")), lambda v: F.struct((s["f"] * v["c"] * v["d"]).alias("f"), v["c"].alias("c"), v["d"].alias("d"), (F.abs(v["c"] * v["d"] - 1) < 1e-15).alias("settled")))))

    start = F.struct(F.lit(1.0).alias("f"), F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(False).alias("settled"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step, lambda s: s["f"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b); null where an argument is."""
    given = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x"))

    def turned(g):
        a, b, x = g["a"], g["b"], g["x"]
        flip = x > (a + 1) / (a + b + 2)
        return F.struct(flip.alias("flip"), F.when(flip, b).otherwise(a).alias("p"), F.when(flip, a).otherwise(b).alias("q"), F.when(flip, 1 - x).otherwise(x).alias("z"))

    def value(t):
        p, q, z = t["p"], t["q"], t["z"]
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(z) + q * F.log(1 - z)) / p
        return _let(front / _fraction(p, q, z), lambda v: F.when(t["flip"], 1 - v).otherwise(v))

    return _let(given, lambda g: F.when(g["x"] <= 0, 0.0).when(g["x"] >= 1, 1.0).when(g["a"].isNotNull() & g["b"].isNotNull() & g["x"].isNotNull(), _let(turned(g), value)))


def t_p_value(t: Column, dof: Column) -> Column:
    """The two-sided p-value of a t statistic."""
    t, dof = t.cast("double"), dof.cast("double")
    return F.when(t == 0, 1.0).otherwise(incomplete_beta(dof / 2, F.lit(0.5), dof / (dof + t * t)))


def f_p_value(f: Column, between: Column, within: Column) -> Column:
    f, between, within = (c.cast("double") for c in (f, between, within))
    return incomplete_beta(within / 2, between / 2, within / (within + between * f))


def t_quantile(level: float, dof: Column) -> Column:
    """The t that |T| exceeds with probability 1 - level, for dof of 1 or more, by bisection."""
    dof = dof.cast("double")

    def step(s, _):
        between = lambda m: _let(t_p_value(m, dof) > 1 - level, lambda above: F.struct(F.when(above, m).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(m).alias("high")))
        return _let((s["low"] + s["high"]) / 2, between)

    # no quantile is beyond that of one degree of freedom
    high = math.tan(math.pi * level / 2) + 1
    start = F.struct(F.lit(0.0).alias("low"), F.lit(high).alias("high"))
    return F.when(dof >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda s: (s["low"] + s["high"]) / 2))
