"""Whole-table ranks, quantiles and ordered pair counts without a single-task sort.

A window without a partition sends every row to one task.  Here rows are dealt out by
range; each range is ordered on its own task and a window over the (few) ranges supplies
the offset.  How many ranges there are follows the rows: Spark's own range partitioning
cuts them.  The cut points only decide where the work goes: every result is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.operators.selection import exact_quantiles
from shelfspan.session import cut_lineage


def dealt_by_range(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` in ascending ranges of ``keys``, numbered in ``_range`` and written once.

    The cuts come from a sample, so the numbers hold only for the rows that are written.
    """
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))


def value_counts(df: DataFrame, value: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """One row per distinct value with its ``ties`` and ``_range``, written once."""
    by = by or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    return dealt_by_range(counted, [*by, value], ranges)


def positions(distinct: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The number of rows ``before`` each distinct value of ``value_counts``.

    Equal values are combined before anything is shuffled by range, so a value holding a
    third of all rows is one row here.
    """
    by = by or []
    totals = distinct.groupBy(*by, "_range").agg(F.sum("ties").alias("_in_range"))
    before_range = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_in_range").over(before_range), F.lit(0))).drop("_in_range")
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        distinct.withColumn("_inside", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
        .join(offsets, [*by, "_range"])
        .select(*by, value, "ties", (F.col("_offset") + F.col("_inside")).alias("before"))
    )


def quantiles(
    df: DataFrame, value: str, named: dict[str, float], by: list[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles, one output column per name."""
    by = by or []
    distinct = value_counts(df, value, by, ranges)
    placed = positions(distinct, value, by)
    total = distinct.groupBy(*by).agg(F.sum("ties").alias("_n"))
    if by:
        placed = placed.join(total, by)
    else:
        placed = placed.withColumn("_n", total.scalar())
    first, after = F.col("before"), F.col("before") + F.col("ties")
    picks = []
    for name, q in named.items():
        at = F.lit(q) * (F.col("_n") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("_n") - 1)
        picks += [
            F.max(F.when((first <= low) & (low < after), F.col(value))).alias(f"{name}_lo"),
            F.max(F.when((first <= high) & (high < after), F.col(value))).alias(f"{name}_hi"),
            F.max(at - low).alias(f"{name}_w"),
        ]
    picked = placed.groupBy(*by).agg(*picks)
    return picked.select(
        *by,
        *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_w")).alias(n) for n in named],
    )


@dataclass(frozen=True)
class Placed:
    """A frame whose ``values`` lie in order: one row per row and value, and one for the row itself."""

    rows: DataFrame
    values: list[str]

    def quantiles(self, named: dict[str, tuple[str, float]]) -> dict[str, float | None]:
        at = lambda value: F.when(F.col("_column") == self.values.index(value), F.col("_value"))
        return exact_quantiles(self.rows.filter("_column >= 0"), {name: (at(value), q) for name, (value, q) in named.items()})

    def _counted(self) -> DataFrame:
        """Rows before each row's value, rows that share it, and rows in all, per value column.

        A value may lie in several ranges.  Only the ends of a range can, so what other
        ranges hold of a value is told by a few rows per range.
        """
        in_order = Window.partitionBy("_range", "_column").orderBy("_value")
        inside = self.rows.filter("_column >= 0").select("_id", "_range", "_column", "_value").withColumns({
            "_less": F.rank().over(in_order) - 1,
            "_peers": F.count("*").over(in_order.rangeBetween(Window.currentRow, Window.currentRow)),
        })
        earlier = Window.partitionBy("_column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ends = inside.groupBy("_range", "_column").agg(
            F.count("*").alias("_rows"), F.min(F.struct("_value", "_peers")).alias("_low"), F.max(F.struct("_value", "_peers")).alias("_high"),
        ).withColumns({
            "_offset": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_all": F.sum("_rows").over(Window.partitionBy("_column")),
        })
        end = lambda c, low, high: F.struct(F.col(f"{c}._value"), F.col(f"{c}._peers"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        one = F.col("_low._value") == F.col("_high._value")
        both = F.when(one, F.array(end("_low", True, True))).otherwise(F.array(end("_low", True, False), end("_high", False, True)))
        held = Window.partitionBy("_column", "_value").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        shared = ends.select("_range", "_column", F.inline(both)).withColumns({
            "_earlier": F.coalesce(F.sum("_peers").over(held), F.lit(0)), "_everywhere": F.sum("_peers").over(Window.partitionBy("_column", "_value")),
        })
        told = shared.groupBy("_range", "_column").agg(
            F.max(F.when(F.col("low"), F.col("_earlier"))).alias("_low_earlier"), F.max(F.when(F.col("low"), F.col("_everywhere"))).alias("_low_all"),
            F.max(F.when(F.col("high"), F.col("_everywhere"))).alias("_high_all"),
        )
        at_low, at_high = F.col("_value") == F.col("_low._value"), F.col("_value") == F.col("_high._value")
        return inside.join(ends.join(told, ["_range", "_column"]), ["_range", "_column"]).select(
            "_id", "_column", (F.col("_offset") + F.col("_less") - F.when(at_low, F.col("_low_earlier")).otherwise(0)).alias("before"),
            F.when(at_low, F.col("_low_all")).when(at_high, F.col("_high_all")).otherwise(F.col("_peers")).alias("ties"), F.col("_all").alias("n"),
        )

    def ranked(self, ranks: dict[str, tuple[str, bool, str]]) -> DataFrame:
        """The frame with a column per rank, as ``rank_all`` describes them."""
        columns = []
        for alias, (value, descending, method) in ranks.items():
            first = (F.col("n") - F.col("before") - F.col("ties")) if descending else F.col("before")
            rank = first + 1 if method == "min" else first + (F.col("ties") + 1) / 2
            if method == "pct":
                rank = rank / F.col("n")
            columns.append(F.max(F.when(F.col("_column") == self.values.index(value), rank)).alias(alias))
        found = self._counted().groupBy("_id").agg(*columns)
        return self.rows.filter("_column = -1").select("_id", "_row.*").join(found, "_id", "left").drop("_id")


def place(df: DataFrame, values: list[str], ranges: int | None = None) -> Placed:
    """All ``values`` of ``df`` in order, in one pass and one write.

    The row's own number is part of the key, so rows that share a value spread over as many
    ranges as their number needs.
    """
    row = F.struct(*df.columns)
    # the row itself travels once, beside its values
    copies = [F.struct(F.lit(-1).alias("_column"), F.lit(None).cast("double").alias("_value"), row.alias("_row"))]
    copies += [F.struct(F.lit(i).alias("_column"), F.col(v).cast("double").alias("_value"), F.when(F.lit(False), row).alias("_row")) for i, v in enumerate(values)]
    # numbered before the copies are made: all copies of a row share its number
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    stacked = numbered.select("_id", F.inline(F.array(*copies))).filter((F.col("_column") < 0) | F.col("_value").isNotNull())
    return Placed(dealt_by_range(stacked, ["_column", "_value", "_id"], ranges), values)


def rank_all(df: DataFrame, ranks: dict[str, tuple[str, bool, str]], ranges: int | None = None) -> DataFrame:
    """Ranks over the whole table, null for null values.

    ``ranks`` maps an output column to (value column, descending, method) with method
    ``min``, ``average`` or ``pct`` (average over n).  ``df`` is read once.
    """
    return place(df, list(dict.fromkeys(value for value, _, _ in ranks.values())), ranges).ranked(ranks)


def ordered_pairs(df: DataFrame, time_code: str, value: str, starts: str, weight: str, codes: int,
                  ranges: int | None = None) -> DataFrame:
    """Pairs (i, j) with ``starts`` of i true and a smaller code than j, by value order.

    One row: ``pairs``, ``concordant`` (value of i below j) and ``tied``.  Codes are whole
    numbers below ``codes``.  Every pair of different codes parts at exactly one bit, so
    each row is placed once per bit and counted by a running sum over the value: no pair
    is ever formed.
    """
    bits = max(int(math.ceil(math.log2(max(codes, 2)))), 1)
    grouped = df.groupBy(time_code, value, starts).agg(F.sum(weight).alias("_w"))
    ranged = dealt_by_range(grouped, [value], ranges)
    halved = ranged.select(
        "_range", value, starts, "_w", F.col(time_code).cast("int").alias("_code"),
        F.explode(F.array(*[F.lit(b) for b in range(bits)])).alias("_bit"),
    ).withColumn("_block", F.expr("shiftright(_code, _bit + 1)")).withColumn(
        "_right", F.expr("shiftright(_code, _bit) & 1")
    )
    left = F.sum(F.when((F.col("_right") == 0) & F.col(starts), F.col("_w")).otherwise(0))
    right = F.sum(F.when(F.col("_right") == 1, F.col("_w")).otherwise(0))
    cell = halved.groupBy("_range", "_bit", "_block", value).agg(left.alias("l"), right.alias("r"))
    below = Window.partitionBy("_range", "_bit", "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = cell.withColumn("_below", F.coalesce(F.sum("l").over(below), F.lit(0))).groupBy("_range", "_bit", "_block").agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"),
        F.sum(F.col("r") * F.col("_below")).alias("concordant"), F.sum(F.col("r") * F.col("l")).alias("tied"),
    )
    lower = Window.partitionBy("_bit", "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    across = inside.withColumn("_lower", F.coalesce(F.sum("l").over(lower), F.lit(0))).groupBy("_bit", "_block").agg(
        F.sum(F.col("concordant") + F.col("r") * F.col("_lower")).alias("concordant"), F.sum("tied").alias("tied"),
        (F.sum("l") * F.sum("r")).alias("pairs"),
    )
    return across.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "concordant", "tied")])
