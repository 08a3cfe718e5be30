"""Upper tails of distributions as column expressions, for p-values inside a query."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on the normal tail is a continued fraction, below it one half less a series; from here on Kolmogorov's alternating series converges at once.
FAR, WIDE = 3.0, 1.18
_TERMS = 90


def normal_upper(z: Column) -> Column:
    """P(Z > z) of a standard normal variable."""
    z = z.cast("double")
    size = F.abs(z)
    density = F.exp(-size * size / 2) / math.sqrt(2 * math.pi)
    term = lambda s, k: F.struct((s["sum"] + s["term"] * size * size / (2 * k + 1)).alias("sum"), (s["term"] * size * size / (2 * k + 1)).alias("term"))
    near = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), F.struct(size.alias("sum"), size.alias("term")), term)["sum"]
    far = density / F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1)), size, lambda t, k: size + k / t)
    tail = F.when(size < FAR, near).otherwise(far)
    return F.when(z < 0, 1 - tail).otherwise(tail)


def chi_square_upper(x: Column, freedom: Column) -> Column:
    """P(X > x) of a chi-square variable; null without a degree of freedom.

    The tail is a finite sum over every second degree, on top of nothing (even) or of a normal tail (odd). Terms are
    kept as logarithms, so none underflows before it counts."""
    half = x.cast("double") / 2
    odd = freedom % 2 == 1
    # the odd sum begins with half^(1/2) / Gamma(3/2), so its k-th step divides by k + 1/2; the even one begins with 1 and divides by k
    log_first = F.when(odd, F.log(half) / 2 - half - math.log(math.sqrt(math.pi) / 2)).otherwise(-half)
    add = lambda s, k: F.struct((s["sum"] + F.exp(s["log"])).alias("sum"), (s["log"] + F.log(half / (F.when(odd, 0.5).otherwise(0.0) + k))).alias("log"))
    many = F.when(odd, (freedom - 1) / 2).otherwise(freedom / 2).cast("int")
    steps = F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(F.lit(0.0).alias("sum"), log_first.alias("log")), add)["sum"]
    tail = F.when(odd, 2 * normal_upper(F.sqrt(2 * half))).otherwise(0.0) + total
    return F.when(freedom >= 1, F.when(half <= 0, 1.0).otherwise(F.least(tail, F.lit(1.0))))


def kolmogorov_upper(x: Column) -> Column:
    """P(K > x) of the Kolmogorov distribution, by its alternating series, or for small x by the series of its theta function."""
    x = x.cast("double")
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    far = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda s, k: s + sign(k) * F.exp(-2.0 * k * k * x * x))
    near = 1 - math.sqrt(2 * math.pi) / x * F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda s, k: s + F.exp(-(2.0 * k - 1) * (2.0 * k - 1) * math.pi**2 / (8 * x * x)))
    return F.when(x <= 0, 1.0).when(x < WIDE, near).otherwise(far)
