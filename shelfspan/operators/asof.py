"""As-of joins: each left row takes the latest right row at or before its own time.

Both sides are stacked and one window per key carries the last right row forward, so the
cost is one shuffle on the keys and a sort, never a range product.  Where one key may hold
a large share of all rows, its times are cut into ranges and the last right row is carried
from range to range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.operators.ordering import dealt_by_range


def _last_right(keys: list[str]):
    carried = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return F.last("_right", ignorenulls=True).over(carried)


def _carried_over_ranges(stacked: DataFrame, keys: list[str], ranges: int | None) -> DataFrame:
    """``_match`` from the row's own range, else from the nearest earlier range that holds its key.

    Rows lie in ranges of key and time, so only the first key of a range can have begun in
    an earlier one: what is carried is at most one row per range.
    """
    dealt = dealt_by_range(stacked.withColumn("_id", F.monotonically_increasing_id()), [*keys, "_t", "_side", "_id"], ranges)
    key = F.struct(*keys)
    ends = dealt.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    last = dealt.filter(F.col("_right").isNotNull()).join(ends, "_range").filter(key.eqNullSafe(F.col("_last"))).groupBy("_range").agg(
        F.max_by("_right", "_t").alias("_right"))
    nothing = F.when(F.lit(False), F.col("_right"))
    ends = ends.join(last, "_range", "left")
    told = ends.select("_range", F.col("_first").alias("_key"), F.lit(0).alias("_gives"), nothing.alias("_right")).unionByName(
        ends.select("_range", F.col("_last").alias("_key"), F.lit(1).alias("_gives"), "_right"))
    so_far = Window.partitionBy("_key").orderBy("_range", "_gives").rowsBetween(Window.unboundedPreceding, 0)
    begun = told.withColumn("_begun", F.last("_right", ignorenulls=True).over(so_far)).filter("_gives = 0").select(
        F.col("_range").alias("_at"), F.col("_key").alias("_first"), "_begun")
    inside = dealt.withColumn("_match", _last_right(["_range", *keys]))
    same = (F.col("_range") == F.col("_at")) & key.eqNullSafe(F.col("_first"))
    return inside.join(begun, same, "left").withColumn("_match", F.coalesce("_match", "_begun"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str] | None = None,
    tolerance_days: int | None = None,
    strict: bool = False,
    hot_keys: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Left rows plus ``right_time`` and ``values`` of the latest match, null when none.

    ``strict`` leaves out matches at exactly the same time.  ``right`` must be unique on
    keys and time when it carries values; without values it is made so here.  ``hot_keys``
    spreads a key's rows over as many tasks as they need, at the price of writing the rows
    once and a second shuffle.
    """
    values = values or []
    taken = [right_time, *values]
    right_rows = right.select(*keys, *taken).filter(F.col(right_time).isNotNull())
    if not values:
        right_rows = right_rows.distinct()
    right_side, left_side = (1, 0) if strict else (0, 1)
    payload = [c for c in left.columns if c not in keys]

    stacked = (
        left.select(*keys, F.col(left_time).alias("_t"), F.lit(left_side).alias("_side"), F.struct(*payload).alias("_left"))
        .unionByName(
            right_rows.select(*keys, F.col(right_time).alias("_t"), F.lit(right_side).alias("_side"),
                              F.struct(*taken).alias("_right")),
            allowMissingColumns=True,
        )
    )
    if hot_keys:
        matched = _carried_over_ranges(stacked, keys, ranges).filter(F.col("_side") == left_side)
    else:
        matched = stacked.withColumn("_match", _last_right(keys)).filter(F.col("_side") == left_side)
    if tolerance_days is not None:
        fresh = F.datediff(F.col("_t"), F.col(f"_match.{right_time}")) <= tolerance_days
        matched = matched.withColumn("_match", F.when(fresh, F.col("_match")))
    return matched.select(*keys, "_left.*", *[F.col(f"_match.{c}").alias(c) for c in taken])
