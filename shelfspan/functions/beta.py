"""The incomplete beta share as a column, by its continued fraction."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series ten steps further on."""
    def series(t: Column) -> Column:
        inverse = 1 / (t * t)
        tail = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / t
        return (t - 0.5) * F.log(t) - t + 0.5 * math.log(2 * math.pi) + tail

    steps = z
    for i in range(1, 10):
        steps = steps * (z + i)
    return let(z + 10, series) - F.log(steps)


def _fraction(v: Column) -> Column:
    """Lentz's evaluation of the continued fraction at ``v.a, v.b, v.x``.

    It settles within a few times the square root of the larger parameter; a term that
    changes nothing any more ends it.
    """
    a, b, x = v["a"], v["b"], v["x"]
    safe = lambda c: F.when(F.abs(c) < TINY, TINY).otherwise(c)
    start = F.struct(F.lit(1.0).alias("c"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("d"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("h"),
                     F.lit(False).alias("settled"))

    def half(acc: Column, term: Column) -> Column:
        step = F.struct((1 / safe(1 + term * acc["d"])).alias("d"), safe(1 + term / acc["c"]).alias("c"))
        return let(step, lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (acc["h"] * s["c"] * s["d"]).alias("h"),
                                            (F.abs(s["c"] * s["d"] - 1) < 1e-15).alias("settled")))

    def advance(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return F.when(acc["settled"], acc).otherwise(let(half(acc, even), lambda s: half(s, odd)))

    terms = F.sequence(F.lit(1), F.ceil(20 + 5 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(terms, start, lambda acc, m: advance(acc, m.cast("double")), lambda acc: acc["h"])


def beta_share(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function at x, with ``rest`` = 1 - x."""
    def share(v: Column) -> Column:
        front = F.exp(log_gamma(v["a"] + v["b"]) - log_gamma(v["a"]) - log_gamma(v["b"]) + v["a"] * F.log(v["x"]) + v["b"] * F.log(v["rest"])) / v["a"]
        part = front * _fraction(v)
        return F.when(v["swapped"], 1 - part).otherwise(part)

    def oriented(v: Column) -> Column:
        far = v["x"] > (v["a"] + 1) / (v["a"] + v["b"] + 2)
        pick = lambda p, q: F.when(far, v[q]).otherwise(v[p])
        return let(F.struct(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("x", "rest").alias("x"), pick("rest", "x").alias("rest"),
                            far.alias("swapped")), share)

    return let(F.struct(a.alias("a"), b.alias("b"), x.alias("x"), rest.alias("rest")), oriented)
