"""Normal distribution as plain column arithmetic.

Spark has no error function, so the distribution function uses the double-precision
rational form published by Hart (1968) and West (2005).
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerator and denominator coefficients, highest power first.
NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
TAIL_FROM = 7.07106781186547
ZERO_FROM = 37.0
ROOT_TWO_PI = 2.506628274631


def _horner(coefficients: list[float], z: Column) -> Column:
    total = F.lit(coefficients[0])
    for value in coefficients[1:]:
        total = total * z + F.lit(value)
    return total


def cdf(x: Column) -> Column:
    z = F.abs(x)
    weight = F.exp(-z * z / 2)
    body = weight * _horner(NUMERATOR, z) / _horner(DENOMINATOR, z)
    fraction = z + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = z + F.lit(step) / fraction
    upper = (
        F.when(z > ZERO_FROM, F.lit(0.0))
        .when(z < TAIL_FROM, body)
        .otherwise(weight / fraction / F.lit(ROOT_TWO_PI))
    )
    return F.when(x > 0, 1 - upper).otherwise(upper)


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def standardised(t: Column, mu: Column, sigma: float) -> Column:
    """Where ln t stands above the mean; -40 (survival one) at or before zero."""
    return F.when(t > 0, (F.log(t) - mu) / F.lit(sigma)).otherwise(F.lit(-40.0))


def lognormal_survival(t: Column, mu: Column, sigma: float) -> Column:
    """P(T > t) for ln T ~ N(mu, sigma); 1 at or before zero.

    The argument is bound once: written out it would be copied into every term of the
    rational form and outgrow generated code.
    """
    return F.get(F.transform(F.array(standardised(t, mu, sigma)), lambda z: cdf(-z)), F.lit(0))
