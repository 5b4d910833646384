"""Tail probabilities as column expressions: series and continued fractions run inside `aggregate` over a sequence."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the recurrence before Stirling's series.
SHIFT = 12


def _steps(start: Column, a: Column, step) -> Column:
    """step(state, i) applied for i = 1, 2, ... as often as the series and the fraction need for a."""
    return F.aggregate(F.sequence(F.lit(1), (80 + 12 * F.sqrt(a)).cast("int")), start, step)


def log_gamma(a: Column) -> Column:
    """ln gamma(a) for a > 0: the recurrence up to a + SHIFT, then Stirling's series."""
    a = a.cast("double")
    z = a + SHIFT
    product = F.lit(0.0)
    for k in range(SHIFT):
        product = product + F.log(a + k)
    w = F.lit(1.0) / (z * z)
    series = (F.lit(1 / 12) - w * (F.lit(1 / 360) - w * (F.lit(1 / 1260) - w / 1680))) / z
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - product


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma Q(a, x) for a > 0: a series below a + 1, a continued fraction from there on; 1 for x <= 0."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    start = F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("total"))

    def add(s, i):
        term = s["term"] * x / (a + i)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = 1 - front * _steps(start, a, add)["total"]
    # Lentz's evaluation of 1 / (x + 1 - a - 1 (1 - a) / (x + 3 - a - ...)); beyond a + 1 no denominator vanishes
    b0 = x + 1 - a
    first = F.struct(b0.alias("b"), F.lit(1e300).alias("c"), (F.lit(1.0) / b0).alias("d"), (F.lit(1.0) / b0).alias("h"))

    def lentz(s, i):
        k = i.cast("double")
        an = -k * (k - a)
        b = s["b"] + 2
        d = F.lit(1.0) / (an * s["d"] + b)
        c = b + an / s["c"]
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    fraction = front * _steps(first, a, lentz)["h"]
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), series)).otherwise(fraction)


def chi2_p(statistic: Column, dof: Column) -> Column:
    """Chance of a chi-square value as large; 1 without degrees of freedom."""
    return F.when(dof > 0, gamma_upper(dof / F.lit(2.0), statistic / F.lit(2.0))).otherwise(1.0)


def normal_two_sided(z: Column) -> Column:
    """Chance of a standard normal value as far from 0: erfc(|z| / sqrt 2) = Q(1/2, z^2 / 2)."""
    return F.when(z.isNotNull(), gamma_upper(F.lit(0.5), z * z / 2))
