"""Exact quantiles of several columns at once by radix selection.

A double becomes a whole number that orders as it does (sign, exponent, mantissa).  A pass
counts 16 bits of it per column below the prefix found so far, so whatever the rows, at
most 65,536 counters per column are kept, and one bin per wanted place reaches the driver.
A bin that holds one value only ends the search early.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGIT, PASSES = 16, 4
_NOT_A_NUMBER = 0x7FF8 << 48


def ordered_code(value: Column) -> Column:
    """The bits of a double as a number that orders like it; zeros are equal, NaN comes last.

    Powers of two and divisions by them are exact, so exponent and mantissa are.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("double")
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(size >= power(guess + 1), guess + 1).when(size < power(guess), guess - 1).otherwise(guess)
    exponent = F.least(F.greatest(exponent, F.lit(-1022.0)), F.lit(1023.0))
    mantissa = (size / power(exponent) * F.lit(2.0**52)).cast("long") - F.lit(1 << 52)
    code = (
        F.when(F.isnan(value), F.lit(_NOT_A_NUMBER))
        .when(size == 0, F.lit(0))
        .when(size == float("inf"), F.lit(0x7FF << 52))
        .when(size < 2.0**-1022, (size * F.lit(2.0**600) * F.lit(2.0**474)).cast("long"))
        .otherwise((exponent.cast("long") + 1023) * F.lit(1 << 52) + mantissa)
    )
    return F.when(value < 0, -code).otherwise(code)


def decoded(code: int) -> float:
    if code < 0:
        return -decoded(-code)
    return struct.unpack("<d", struct.pack("<q", code))[0]


def _bins(coded: DataFrame, level: int, opened: dict[int, set[int]]) -> DataFrame:
    """Per column, open prefix and next digit: rows, and the smallest and largest code."""
    above = F.expr(f"shiftright(code, {64 - DIGIT * level})") if level else F.lit(0).cast("long")
    if level:
        inside = F.lit(False)
        for column, prefixes in opened.items():
            inside = inside | ((F.col("column") == column) & above.isin(*prefixes))
        coded = coded.filter(inside)
    digits = coded.groupBy("column", above.alias("above"), F.expr(f"shiftright(code, {64 - DIGIT * (level + 1)})").alias("prefix"))
    return digits.agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"))


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Linearly interpolated quantiles of whole columns, null where a column has no value.

    ``wanted`` names a column and a share between 0 and 1.  ``df`` is read once per pass, up
    to four times: write it first when it is costly.
    """
    names = list(wanted)
    if not names:
        return {}
    codes = F.array(*[ordered_code(column.cast("double")) for column, _ in wanted.values()])
    coded = df.select(F.posexplode(codes).alias("column", "code")).filter(F.col("code").isNotNull())
    shares = F.array(*[F.lit(float(q)) for _, q in wanted.values()])
    by_digit = Window.partitionBy("column", "above").orderBy("prefix")
    first = (
        _bins(coded, 0, {})
        .withColumn("before", F.sum("n").over(by_digit) - F.col("n"))
        .withColumn("at", F.element_at(shares, F.col("column") + 1) * (F.sum("n").over(Window.partitionBy("column")) - 1))
    )
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    rows = first.filter(holds(F.floor("at")) | holds(F.ceil("at"))).collect()
    at = {r["column"]: r["at"] for r in rows}
    # (column, rank among the rows below the open prefix) of every place still searched
    found: dict[tuple[int, int], float] = {}
    searched = {(c, place): (0, place) for c, a in at.items() for place in (math.floor(a), math.ceil(a))}
    for level in range(PASSES):
        if level:
            opened: dict[int, set[int]] = {}
            for (c, _), (prefix, _) in searched.items():
                opened.setdefault(c, set()).add(prefix)
            wanted_places = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).cast("long").alias("above"), F.lit(r).cast("long").alias("rank"))
                                      for (c, _), (p, r) in searched.items()])
            asked = lambda t: (t["column"] == F.col("column")) & (t["above"] == F.col("above")) & holds(t["rank"])
            rows = _bins(coded, level, opened).withColumn("before", F.sum("n").over(by_digit) - F.col("n")).filter(F.exists(wanted_places, asked)).collect()
        still = {}
        for (c, place), (prefix, rank) in searched.items():
            hit = next(r for r in rows if r["column"] == c and r["above"] == prefix and r["before"] <= rank < r["before"] + r["n"])
            if hit["low"] == hit["high"]:
                found[c, place] = decoded(hit["low"])
            else:
                still[c, place] = (hit["prefix"], rank - hit["before"])
        searched = still
        if not searched:
            break
    out: dict[str, float | None] = {}
    for c, name in enumerate(names):
        if c not in at:
            out[name] = None
            continue
        low, high = found[c, math.floor(at[c])], found[c, math.ceil(at[c])]
        out[name] = low if low == high else low + (high - low) * (at[c] - math.floor(at[c]))
    return out


def exact_medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return exact_quantiles(df, {name: (column, 0.5) for name, column in columns.items()})
