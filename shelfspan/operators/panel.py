"""The daily panel: stock with the day's sales and orders, receipts inferred from the movement."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIR = ["store_id", "sku_uid"]
GRAIN = [*PAIR, "date"]


def assemble_panel(
    inventory: DataFrame,
    sales: DataFrame | None = None,
    orders: DataFrame | None = None,
    carry: list[str] | None = None,
    order_measure: str = "qty",
) -> DataFrame:
    """One row per store x SKU x day with ``units_sold``, ``received`` and ``ordered``.

    Stock, sales and orders are stacked and meet in one shuffle by pair; sums per day and
    the movement between days are windows over that layout, which later windows per pair
    reuse.  A receipt is a rise that sales do not explain and is only read across exactly
    one day.
    """
    carry = carry or []
    stacked = inventory.filter(F.col("date").isNotNull()).select(
        *GRAIN, F.col("store_stock").try_cast("double").alias("store_stock"), *carry, F.lit(True).alias("_on_shelf"))
    for facts, measure, name in ((sales, "units_sold", "units_sold"), (orders, order_measure, "ordered")):
        if facts is not None:
            day_of_pair = facts.dropna(subset=GRAIN).select(*GRAIN, F.col(measure).cast("double").alias(name))
            stacked = stacked.unionByName(day_of_pair, allowMissingColumns=True)
        else:
            stacked = stacked.withColumn(name, F.lit(None).cast("double"))
    same_day = Window.partitionBy(*GRAIN)
    summed = stacked.repartition(*PAIR).withColumns({
        c: F.coalesce(F.sum(c).over(same_day), F.lit(0.0)) for c in ("units_sold", "ordered")
    })
    return infer_receipts(summed.filter("_on_shelf")).select(*GRAIN, "store_stock", "units_sold", "received", "ordered", *carry)


def infer_receipts(ledger: DataFrame) -> DataFrame:
    """Add ``received``: the rise in stock across one day that sales do not explain."""
    by_day = Window.partitionBy(*PAIR).orderBy("date")
    rise = F.col("store_stock") - F.col("_before") + F.col("units_sold")
    return (
        ledger.withColumns({
            "_before": F.lag("store_stock").over(by_day),
            "_gap": F.datediff("date", F.lag("date").over(by_day)),
        })
        .withColumn("received", F.when((F.col("_gap") == 1) & (rise > 0), rise).otherwise(0.0))
        .drop("_before", "_gap")
    )


def movements(panel: DataFrame) -> DataFrame:
    """Day-over-day movement: comparable flag, previous stock and the implied receipt."""
    by_day = Window.partitionBy(*PAIR).orderBy("date")
    return panel.withColumns({
        "prev_stock": F.lag("store_stock").over(by_day),
        "gap_days": F.datediff("date", F.lag("date").over(by_day)),
    }).withColumns({
        "comparable": F.coalesce(F.col("prev_stock").isNotNull() & (F.col("gap_days") == 1), F.lit(False)),
        "implied_receipt": F.col("store_stock") - F.col("prev_stock") + F.col("units_sold"),
    })


def value_on(panel: DataFrame, positions: DataFrame, day, column: str, alias: str | None = None) -> DataFrame:
    """``column`` of the panel on one day, attached to every position (null when absent)."""
    on_day = panel.filter(F.col("date") == day).groupBy(*PAIR).agg(F.min(column).alias(alias or column))
    return positions.join(on_day, PAIR, "left")


def density(panel: DataFrame) -> DataFrame:
    """Per pair: observed days against the days its own window should hold."""
    return panel.groupBy(*PAIR).agg(
        F.count("*").alias("observed"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("expected"),
    ).withColumn("dense", F.col("observed") == F.col("expected"))


def panel_end(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.max("date").alias("panel_end"))


def latest_backtest_date(inventory: DataFrame, horizon: int) -> DataFrame:
    return panel_end(inventory).select(F.date_sub("panel_end", horizon).alias("as_of"))


def backtest_date(inventory: DataFrame, horizon: int, requested: str | date | None = None) -> date:
    """The day to score at: the one asked for, else the latest that leaves the horizon to be observed.

    A day before the panel opens, or too late to see an outcome, is an error that says so.
    """
    first, last = inventory.agg(F.min("date"), F.max("date")).first()
    if last is None:
        raise ValueError("the panel has no days")
    latest = last - timedelta(days=horizon)
    if requested is None:
        return latest
    day = requested if isinstance(requested, date) else date.fromisoformat(requested)
    if day < first:
        raise ValueError(f"the panel opens {first}; {day} is before any position exists")
    if day > latest:
        raise ValueError(f"the panel ends {last}, so {day} leaves no room for {horizon} days; the latest day is {latest}")
    return day


def actual_outcomes(panel: DataFrame, positions: DataFrame, as_of, horizon: int) -> DataFrame:
    """Days from ``as_of`` to the first empty shelf inside the horizon, null when none.

    ``as_of`` is a column, usually a scalar subquery, so the date filter stays in the scan.
    """
    first_empty = (
        panel.filter((F.col("date") > as_of) & (F.col("date") <= F.date_add(as_of, horizon)))
        .filter("store_stock <= 0")
        .groupBy(*PAIR).agg(F.min("date").alias("_first"))
        .select(*PAIR, F.datediff("_first", as_of).alias("actual_days_to_stockout"))
    )
    return positions.join(first_empty, PAIR, "left")
