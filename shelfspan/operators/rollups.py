"""Descriptive rollups: lead times, suppliers, forecast accuracy, positions, network totals.

Where an input has many rows per group the groups are first cut down to one row per
group and value, so a hot vendor, store or day costs no more than its distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan import params as P
from shelfspan.functions.values import clip
from shelfspan.operators.asof import asof_join
from shelfspan.operators.ordering import quantiles
from shelfspan.operators.panel import PAIR
from shelfspan.operators.selection import exact_medians
from shelfspan.session import cut_lineage


# --- lead times -----------------------------------------------------------
def infer_lead_times(panel: DataFrame, orders: DataFrame, max_lag_days: int = 30) -> DataFrame:
    """Days from the latest order to each inferred receipt; receipts without one are left out."""
    receipts = panel.filter("received > 0").select(*PAIR, "date")
    matched = asof_join(receipts, orders.withColumnRenamed("date", "order_date"), PAIR, "date", "order_date",
                        tolerance_days=max_lag_days)
    return matched.filter(F.col("order_date").isNotNull()).select(*PAIR, F.datediff("date", "order_date").alias("lead_days"))


def lead_time_summary(lead_times: DataFrame) -> DataFrame:
    """Days are few, so the exact percentile holds one counter per day."""
    return lead_times.agg(
        F.count("*").alias("n"), F.avg("lead_days").alias("mean"), F.stddev_samp("lead_days").alias("std"),
        F.percentile("lead_days", 0.95).alias("p95"),
    )


def lead_times_by_store(lead_times: DataFrame) -> DataFrame:
    return lead_times.groupBy("store_id").agg(
        F.count("*").alias("n"), F.avg("lead_days").alias("mean"), F.stddev_samp("lead_days").alias("std"),
        F.percentile("lead_days", 0.9).alias("p90"),
    )


def lead_distribution(receipts: DataFrame, days: str = "lead_days") -> DataFrame:
    seen = receipts.filter(F.col(days).isNotNull())
    return seen.agg(
        F.count("*").alias("n"), F.avg(days).alias("mean"), F.stddev_samp(days).alias("std"),
        F.percentile(days, 0.5).alias("p50"), F.percentile(days, 0.9).alias("p90"),
    )


def lead_histogram(receipts: DataFrame, days: str = "lead_days") -> DataFrame:
    return receipts.filter(F.col(days) >= 0).groupBy(F.col(days).alias("days")).agg(F.count("*").alias("receipts"))


def supplier_performance(receipts: DataFrame, vendor: str = "Vendor_Name") -> DataFrame:
    return receipts.filter(F.col("lead_days_actual").isNotNull() & F.col(vendor).isNotNull()).groupBy(F.col(vendor).alias("vendor")).agg(
        F.count("*").alias("receipts"),
        F.avg(F.col("on_time").cast("int")).alias("on_time_rate"),
        F.avg("lead_days_promised").alias("lead_days_promised"),
        F.avg("lead_days_actual").alias("lead_days_actual"),
        F.stddev_samp("lead_days_actual").alias("lead_days_std"),
        F.percentile("days_late", 0.9).alias("days_late_p90"),
        F.sum(F.col("Qty_Received").cast("double")).alias("units"),
    )


# --- forecast -------------------------------------------------------------
def forecast_weekly(plan: DataFrame) -> DataFrame:
    return plan.groupBy("date").agg(
        F.sum(F.coalesce("forecast_units", F.lit(0.0))).alias("forecast"),
        F.sum(F.coalesce("actual_units", F.lit(0.0))).alias("actual"),
    ).withColumn("error", F.col("forecast") - F.col("actual"))


def forecast_accuracy(plan: DataFrame) -> DataFrame:
    """Bias of the totals, and the median absolute relative error where something sold."""
    sold = plan.filter("actual_units > 0").withColumn(
        "ape", F.abs(F.coalesce("forecast_units", F.lit(0.0)) - F.col("actual_units")) / F.col("actual_units")
    )
    mape = quantiles(sold, "ape", {"mape": 0.5}).scalar()
    return plan.agg((F.sum("forecast_units") / F.nullif(F.sum("actual_units"), F.lit(0.0))).alias("bias")).withColumn("mape", mape)


# --- panel rollups --------------------------------------------------------
def daily_trend(panel: DataFrame) -> DataFrame:
    """Network totals per day; DC stock counts once per SKU, at its smallest report."""
    flows = [c for c in ("units_sold", "received", "ordered") if c in panel.columns]
    extra = [c for c in ("intransit_stock",) if c in panel.columns]
    out = panel.groupBy("date").agg(
        F.sum("store_stock").alias("on_hand"), *[F.sum(c).alias(c) for c in flows + extra]
    )
    if "warehouse_stock" in panel.columns:
        pool = panel.groupBy("date", "sku_uid").agg(F.min("warehouse_stock").alias("w"))
        out = out.join(pool.groupBy("date").agg(F.sum("w").alias("warehouse_stock")), "date", "left")
    return out


def last_days(trend: DataFrame, days: int) -> DataFrame:
    return trend.orderBy(F.desc("date")).limit(days)


def position_snapshot(panel: DataFrame, as_of: Column, rate_days: int = P.RATE_DAYS) -> DataFrame:
    """Every pair observed on the day: stock, demand rate, days of supply and excess.

    One pass over the rate window.  Days of supply are null where the rate is too small
    to divide by.
    """
    today = F.col("date") == as_of
    others = [c for c in ("warehouse_stock", "intransit_stock") if c in panel.columns]
    seen = panel.filter((F.col("date") > F.date_sub(as_of, rate_days)) & (F.col("date") <= as_of)).groupBy(*PAIR).agg(
        F.max(F.when(today, F.lit(1))).alias("_today"),
        F.max(F.when(today, F.col("store_stock"))).alias("store_stock"),
        *[F.max(F.when(today, F.col(c))).alias(c) for c in others],
        (F.sum("units_sold") / rate_days).alias("demand_rate"),
    ).filter("_today = 1").drop("_today")
    return seen.withColumns({
        "days_of_supply": F.when(F.col("demand_rate") > 0.01, F.col("store_stock") / F.col("demand_rate")),
        "excess_units": F.greatest(F.col("store_stock") - F.col("demand_rate") * P.EXCESS_COVER_DAYS, F.lit(0.0)),
    })


def turnover(panel: DataFrame, as_of: Column, days: int = P.TURNOVER_DAYS) -> DataFrame:
    """Annualised units sold over the mean of daily total stock."""
    daily = panel.filter(F.col("date") > F.date_sub(as_of, days)).groupBy("date").agg(
        F.sum("units_sold").alias("u"), F.sum("store_stock").alias("s")
    )
    yearly = F.sum("u") / F.count("*") * P.DAYS_IN_YEAR
    return daily.agg(F.coalesce(yearly / F.when(F.avg("s") > 0, F.avg("s")), F.lit(0.0)).alias("turnover"))


def network_totals(snapshot: DataFrame) -> DataFrame:
    cover = quantiles(snapshot, "days_of_supply", {"median_days_of_supply": 0.5}).scalar()
    out = snapshot.agg(
        F.count("*").alias("positions"), F.sum("excess_units").alias("excess_units"), F.sum("store_stock").alias("on_hand_units"),
        *([F.sum("intransit_stock").alias("intransit_units")] if "intransit_stock" in snapshot.columns else []),
    ).withColumn("median_days_of_supply", cover)
    if "warehouse_stock" in snapshot.columns:
        pool = snapshot.groupBy("sku_uid").agg(F.min("warehouse_stock").alias("w")).agg(F.sum("w").alias("dc_units"))
        out = out.withColumn("dc_units", pool.scalar())
    return out


def cover_histogram(snapshot: DataFrame) -> DataFrame:
    """Right-closed buckets over the positions whose cover is known."""
    bucket = F.lit(P.COVER_BUCKETS[-1][0])
    for name, upper in reversed(P.COVER_BUCKETS[:-1]):
        bucket = F.when(F.col("days_of_supply") <= upper, F.lit(name)).otherwise(bucket)
    counted = snapshot.filter(F.col("days_of_supply").isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("k"))
    every = reduce(lambda a, b: a.unionByName(b), [
        snapshot.agg(F.lit(name).alias("bucket"), F.lit(0).cast("bigint").alias("k")) for name, _ in P.COVER_BUCKETS
    ])
    return counted.unionByName(every).groupBy("bucket").agg(F.sum("k").alias("positions"))


def inventory_by_store(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("store_id").agg(
        F.sum("store_stock").alias("on_hand"), F.count("*").alias("skus"), F.sum("excess_units").alias("excess")
    )


def open_orders(orders: DataFrame, as_of: Column, lead_mean: Column) -> DataFrame:
    """Orders placed within the (rounded up) mean lead time of the day."""
    days = F.ceil(F.coalesce(lead_mean, F.lit(P.LEAD_FALLBACK_DAYS))).cast("int")
    recent = (F.col("date") > F.date_sub(as_of, days)) & (F.col("date") <= as_of)
    return orders.filter(recent).agg(F.count("*").alias("open_orders"))


# --- calibration ----------------------------------------------------------
def demand_dispersion(sales: DataFrame, inventory: DataFrame, min_days: int = 30) -> DataFrame:
    """Median negative-binomial k over pairs whose demand on sale days in stock is overdispersed.

    A day without a sale row says nothing about demand, and one without stock is censored.
    """
    in_stock = inventory.filter(F.col("store_stock").try_cast("double") > 0).select(*PAIR, "date").distinct()
    sold = sales.select(*PAIR, "date", F.col("units_sold").try_cast("double").alias("units_sold")).join(in_stock, [*PAIR, "date"], "left_semi")
    per_pair = sold.groupBy(*PAIR).agg(
        F.avg("units_sold").alias("m"), F.var_samp("units_sold").alias("v"), F.count("units_sold").alias("n")
    ).filter((F.col("n") >= min_days) & (F.col("m") > 0) & (F.col("v") > F.col("m")))
    per_pair = cut_lineage(per_pair)
    median = exact_medians(per_pair, {"k": F.col("m") * F.col("m") / (F.col("v") - F.col("m"))})["k"]
    low, high = P.DISPERSION_BOUNDS
    # one row whatever the sales hold
    return per_pair.agg(F.lit(high if median is None else min(max(median, low), high)).alias("dispersion"))


def weekday_factors(sales: DataFrame) -> DataFrame:
    """Seven multipliers, Monday first, as one array."""
    daily = sales.filter(F.col("date").isNotNull()).groupBy(F.weekday("date").alias("w")).agg(
        F.sum(F.coalesce("units_sold", F.lit(0.0))).alias("u"), F.count("*").alias("n")
    )
    overall = F.sum("u") / F.sum("n")
    low, high = P.WEEKDAY_BOUNDS
    one = lambda w: F.coalesce(clip(F.max(F.when(F.col("w") == w, F.col("u") / F.col("n"))) / F.nullif(overall, F.lit(0.0)), low, high), F.lit(1.0))
    return daily.agg(F.array(*[one(w) for w in range(7)]).alias("weekday_factor"))


def forecast_error(forecast: DataFrame, sales: DataFrame, products: DataFrame, min_rows: int = P.FORECAST_MIN_ROWS) -> DataFrame:
    """Median ratio of plan to sales and the spread of its logarithm."""
    monthly = sales.filter(F.col("date").isNotNull()).groupBy(
        "sku_uid", F.year("date").alias("year"), F.month("date").alias("month")
    ).agg(F.sum("units_sold").alias("sold"))
    named = products.groupBy("sku_uid").agg(F.min("option_uid").alias("option_uid"), F.min("size").alias("size"))
    joined = (
        monthly.join(named, "sku_uid").join(forecast.select("option_uid", "size", "year", "month", "prediction_size"),
                                            ["option_uid", "size", "year", "month"])
        .filter("sold > 0 and prediction_size > 0").withColumn("ratio", F.log(F.col("prediction_size") / F.col("sold")))
    )
    median = quantiles(joined, "ratio", {"m": 0.5}).scalar()
    enough = F.count("*") >= min_rows
    bias, sigma = P.FORECAST_FALLBACK
    return joined.agg(
        F.count("*").alias("n"), F.stddev_samp("ratio").alias("s"), enough.alias("enough")
    ).select(
        "n", F.when(F.col("enough"), F.exp(median)).otherwise(bias).alias("forecast_bias"),
        F.when(F.col("enough"), F.col("s")).otherwise(sigma).alias("forecast_sigma"),
    )


def calibrate(panel: DataFrame, sales: DataFrame, orders: DataFrame, forecast: DataFrame, products: DataFrame,
              min_days: int = 30, min_rows: int = P.FORECAST_MIN_ROWS) -> DataFrame:
    """Everything the projection needs, as one row."""
    lead = lead_time_summary(infer_lead_times(panel, orders))
    error = forecast_error(forecast, sales, products, min_rows)
    dispersion = demand_dispersion(sales, panel, min_days).scalar()
    return error.select(
        "forecast_bias", "forecast_sigma",
        F.greatest(dispersion, F.lit(P.MIN_DISPERSION)).alias("dispersion"),
        F.coalesce(lead.select("mean").scalar(), F.lit(P.LEAD_FALLBACK_DAYS)).alias("lead_mean"),
        F.coalesce(lead.select("std").scalar(), F.lit(0.0)).alias("lead_sigma"),
        lead.select("n").scalar().alias("n_lead_observations"),
        weekday_factors(sales).scalar().alias("weekday_factor"),
    )
