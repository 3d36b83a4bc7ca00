"""Policy-arm metrics, the weekly demand index, attention shares and the plan split by store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.operators.ordering import rank_all
from shelfspan.session import cut_lineage

UP, DOWN, STABLE = "Trending Up", "Trending Down", "Stable"


def arm_metrics(panels: DataFrame, spells: DataFrame) -> DataFrame:
    """Service and holding side by side per ``arm``."""
    lost, sold = F.sum("lost_units"), F.sum("units_sold")
    flows = panels.groupBy("arm").agg(
        F.count_if(F.col("store_stock") <= 0).alias("days_out_of_stock"), F.avg((F.col("store_stock") <= 0).cast("int")).alias("days_out_of_stock_pct"),
        (sold + lost).alias("units_demanded"), sold.alias("units_sold"), lost.alias("units_lost"),
        F.coalesce(1 - lost / F.nullif(sold + lost, F.lit(0.0)), F.lit(1.0)).alias("fill_rate"), F.avg("store_stock").alias("avg_store_stock"),
        (F.sum("store_stock") / F.count_distinct("date")).alias("avg_inventory_units"),
    )
    ends = spells.groupBy("arm").agg(F.count("*").alias("spells"), F.sum("event").alias("stockout_events"), F.avg("event").alias("stockout_rate"))
    return flows.join(ends, "arm", "left")


def week_of(date: str):
    return F.to_date(F.date_trunc("week", F.col(date).cast("timestamp")))


def demand_index(panel: DataFrame, group: list[str]) -> DataFrame:
    """Weekly latent demand (sold and lost) per group over the group's own weekly mean."""
    weekly = panel.groupBy(*group, week_of("date").alias("week")).agg(
        F.sum(F.col("units_sold") + F.col("lost_units")).alias("latent_units"), F.sum("lost_units").alias("lost_units")
    )
    mean = F.avg("latent_units").over(Window.partitionBy(*group))
    return weekly.withColumn("demand_index", F.coalesce(F.col("latent_units") / F.greatest(mean, F.lit(1e-6)), F.lit(1.0)))


def leading_index(index: DataFrame, group: list[str], lead: int = 1, threshold: float = 0.1) -> DataFrame:
    """The index of ``lead`` weeks on, its change on the week before, and the trend label."""
    by_week = Window.partitionBy(*group).orderBy("week")
    ahead = index.withColumn("buzz_index", F.least(F.greatest(
        F.coalesce(F.lead("demand_index", lead).over(by_week), F.col("demand_index")), F.lit(0.05)), F.lit(12.0)))
    before = F.lag("buzz_index").over(by_week)
    change = F.coalesce((F.col("buzz_index") - before) / F.greatest(before, F.lit(1e-6)), F.lit(0.0))
    return ahead.withColumn("buzz_wow", change).withColumn(
        "trend_signal", F.when(F.col("buzz_wow") > threshold, UP).when(F.col("buzz_wow") < -threshold, DOWN).otherwise(STABLE)
    )


def brand_groups(groups: DataFrame, own: list[str], others: list[str]) -> DataFrame:
    """Every group for every brand of a fixed list."""
    brands = [F.struct(F.lit(b).alias("brand"), F.lit(b in own).alias("brand_is_own")) for b in [*own, *others]]
    return groups.select("*", F.inline(F.array(*brands)))


def share_of_voice(mentions: DataFrame, group: list[str], count: str = "mentions") -> DataFrame:
    """Mentions over the group's total, in percent.  One row per brand and group comes in."""
    totals = mentions.groupBy(*group).agg(F.sum(count).alias("_total"))
    return mentions.join(totals, group).withColumn("share_of_voice_pct", F.round(F.col(count) / F.col("_total") * 100, 2)).drop("_total")


def complaint_pressure(index: DataFrame, city: str = "city_norm") -> DataFrame:
    """Lost units against the worst group of the city, 0 to 1."""
    worst = index.groupBy(city).agg(F.greatest(F.max("lost_units"), F.lit(1.0)).alias("_worst"))
    return index.join(worst, city).withColumn(
        "complaint_pressure", F.least(F.greatest(F.col("lost_units") / F.col("_worst"), F.lit(0.0)), F.lit(1.0))
    ).drop("_worst")


def rank_correlation(frame: DataFrame, left: str, right: str) -> DataFrame:
    """Spearman's rho over rows where both are known."""
    known = cut_lineage(frame.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, right))
    ranked = rank_all(known, {"_l": (left, False, "average"), "_r": (right, False, "average")})
    return ranked.agg(F.count("*").alias("n"), F.corr("_l", "_r").alias("rho"))


def lead_check(index: DataFrame, group: list[str], column: str = "buzz_index") -> DataFrame:
    """Rank correlation of the index with next week's demand and with this week's."""
    following = index.withColumn("next_demand", F.lead("demand_index").over(Window.partitionBy(*group).orderBy("week")))
    ahead = rank_correlation(following, column, "next_demand").withColumn("against", F.lit("next_week"))
    return ahead.unionByName(rank_correlation(following, column, "demand_index").withColumn("against", F.lit("this_week")))


def store_week_plan(panel: DataFrame, chain_plan: DataFrame | None = None) -> DataFrame:
    """A SKU's weekly chain plan split by each store's share of the SKU's units.

    Without a plan the chain's own weekly units stand in.
    """
    weekly = panel.groupBy("store_id", "sku_uid", week_of("date").alias("week")).agg(F.sum("units_sold").alias("actual_units"))
    by_store = weekly.groupBy("store_id", "sku_uid").agg(F.sum("actual_units").alias("store_units"))
    chain = by_store.groupBy("sku_uid").agg(F.sum("store_units").alias("chain_units"))
    share = by_store.join(chain, "sku_uid").select("store_id", "sku_uid", (F.col("store_units") / F.greatest("chain_units", F.lit(1.0))).alias("store_share"))
    plan = chain_plan or weekly.groupBy("sku_uid", "week").agg(F.sum("actual_units").alias("plan_units"))
    return weekly.join(share, ["store_id", "sku_uid"], "left").join(plan, ["sku_uid", "week"], "left").withColumn(
        "forecast_units", F.round(F.coalesce("plan_units", F.lit(0.0)) * F.coalesce("store_share", F.lit(0.0)), 2)
    )
