"""p-values as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Steps of the recurrence that brings a small argument to where the asymptotic series holds.
SHIFT = 10


def log_half_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for a > 0, to about 1e-12 and without cancellation for large ``a``."""
    y = a + SHIFT
    series = F.log(y) / 2 - 1 / (8 * y) + 1 / (192 * y * y * y) - 1 / (640 * F.pow(y, F.lit(5))) + 17 / (14336 * F.pow(y, F.lit(7)))
    for i in range(SHIFT):
        series += F.log((a + i) / (a + i + 0.5))
    return series


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function, by the modified Lentz method.

    It converges for x below (a + 1) / (a + b + 2) within a multiple of the square root of the larger parameter.
    """
    one = F.lit(1.0)
    start = F.struct(one.alias("c"), (1 / (1 - (a + b) * x / (a + 1))).alias("d"), (1 / (1 - (a + b) * x / (a + 1))).alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        c1, d1 = 1 + even / s["c"], 1 / (1 + even * s["d"])
        c2, d2 = 1 + odd / c1, 1 / (1 + odd * d1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * c1 * d1 * c2 * d2).alias("h"))

    steps = (100 + 5 * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["h"])


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` of ``n`` pairs under independent normal values.

    It is the regularised incomplete beta function of 1 - r^2 with parameters (n - 2) / 2 and
    1/2. Null for fewer than three pairs or a null or NaN r; 0 for r = +-1.
    """
    a, half = (n.cast("double") - 2) / 2, F.lit(0.5)
    x, y = (1 - r) * (1 + r), r * r
    log_beta = F.lit(math.log(math.pi) / 2) - log_half_step(a)
    log_x = F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(x))
    front = F.exp(a * log_x + F.log(y) / 2 - log_beta)
    tail = F.when(x < (a + 1) / (a + 2.5), front / a * _fraction(x, a, half)).otherwise(1 - 2 * front * _fraction(y, half, a))
    inside = F.when(x <= 0, 0.0).when(y == 0, 1.0).otherwise(tail)
    return F.when((n >= 3) & r.isNotNull() & ~F.isnan(r), F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)))
