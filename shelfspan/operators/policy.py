"""Reorder points: the survival model solved for cover, and the lead-time demand quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan import params as P
from shelfspan.functions import normal
from shelfspan.functions.beta import beta_share, let

COVER = "log_days_of_cover"


def reorder_cover(model, horizon: Column, service_level: float) -> Column:
    """Cover at which the chance of running out by the horizon is one minus the service level.

    The model is linear in log cover, so the root is closed form; it needs a positive
    coefficient and is kept inside the search bounds, the upper one meaning unreachable.
    """
    b = dict(zip(model.features, model.coefficients)).get(COVER, 0.0)
    if b <= 0:
        raise ValueError("predicted risk does not fall with days of cover in this model")
    rest = model.mu() - F.lit(b) * F.col(COVER)
    needed = (F.log(horizon) - F.lit(model.sigma * normal.quantile(1 - service_level)) - rest) / F.lit(b)
    low, high = P.COVER_BOUNDS
    return F.least(F.greatest(F.expm1(F.least(needed, F.lit(math.log1p(high)))), F.lit(low)), F.lit(high))


def reorder_from_model(latest: DataFrame, model, horizon: Column, service_level: float = P.SERVICE_LEVEL) -> DataFrame:
    cover = reorder_cover(model, horizon, service_level)
    return latest.withColumns({"_cover": cover, "_rate": F.greatest("trailing_demand_rate", F.lit(0.01)), "protection_days": horizon}).select(
        "store_id", "sku_uid", "trailing_demand_rate", "protection_days", F.lit(service_level).alias("service_level"),
        F.round("_cover", 2).alias("recommended_cover_days"), F.ceil(F.col("_cover") * F.col("_rate")).alias("recommended_reorder_point"),
        F.ceil(F.col("_rate") * F.col("protection_days") + P.TEXTBOOK_Z * F.sqrt(F.col("_rate") * F.col("protection_days"))).alias("textbook_reorder_point"),
        F.round(F.col("_rate") * F.col("protection_days"), 2).alias("expected_demand_over_lead"),
    ).withColumn("safety_stock", F.round(F.col("recommended_reorder_point") - F.col("expected_demand_over_lead"), 2))


def negative_binomial_cdf(count: Column, mean: Column, k: Column) -> Column:
    """P(X <= count) for a count of 0 or more: an incomplete beta share, whatever the size of the count."""
    share = k / (k + mean)
    return beta_share(k.cast("double"), count.cast("double") + 1, share, 1 - share)


def negative_binomial_quantile(mean: Column, k: Column, q: float) -> Column:
    """Smallest count whose distribution function reaches ``q``.

    By the one-sided Chebyshev inequality the answer is at most mean + sqrt(variance * q /
    (1 - q)); the bracket below that is halved as often as its width has bits, so the work
    grows with the logarithm of the demand and nothing as long as the demand is made.
    """
    m = F.greatest(mean, F.lit(1e-6))
    reach = F.ceil(m + F.sqrt((m + m * m / k) * q / (1 - q))).cast("long") + 1

    def search(given: Column) -> Column:
        start = F.struct(F.lit(-1).cast("long").alias("below"), given["reach"].alias("reached"))

        def halve(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["below"] + acc["reached"]) / 2)
            enough = negative_binomial_cdf(middle, given["m"], given["k"]) >= q
            return F.when(acc["reached"] - acc["below"] <= 1, acc).otherwise(
                let(F.struct(enough.alias("enough"), middle.alias("middle")), lambda tried: F.struct(
                    F.when(tried["enough"], acc["below"]).otherwise(tried["middle"]).alias("below"),
                    F.when(tried["enough"], tried["middle"]).otherwise(acc["reached"]).alias("reached"))))

        halvings = F.sequence(F.lit(1), F.ceil(F.log2(given["reach"] + 1)).cast("int") + 1)
        return F.aggregate(halvings, start, halve, lambda acc: acc["reached"])

    return let(F.struct(m.alias("m"), k.cast("double").alias("k"), reach.alias("reach")), search)


def reorder_from_demand(latest: DataFrame, lead_mean: Column, lead_std: Column, dispersion: Column,
                        service_level: float = P.SERVICE_LEVEL) -> DataFrame:
    """Quantile of demand over the mean lead time plus its spread."""
    days = F.coalesce(lead_mean, F.lit(P.LEAD_FALLBACK_DAYS)) + F.coalesce(lead_std, F.lit(0.0))
    placed = latest.withColumns({"_days": days, "_k": dispersion, "_rate": F.greatest("trailing_demand_rate", F.lit(0.001))})
    demand = F.col("_rate") * F.col("_days")
    return placed.withColumn("_demand", demand).withColumn(
        "recommended_reorder_point", negative_binomial_quantile(F.col("_demand"), F.col("_k"), service_level)
    ).select(
        "store_id", "sku_uid", "trailing_demand_rate", F.round("_days", 2).alias("protection_days"),
        F.lit(service_level).alias("service_level"), F.round("_k", 3).alias("dispersion_k"),
        F.round("_demand", 2).alias("expected_demand_over_lead"), "recommended_reorder_point",
        F.ceil(F.col("_demand") + P.TEXTBOOK_Z * F.sqrt("_demand")).alias("textbook_reorder_point"),
        F.round(F.col("recommended_reorder_point") / F.col("_rate"), 2).alias("recommended_cover_days"),
    ).withColumn("safety_stock", F.col("recommended_reorder_point") - F.col("expected_demand_over_lead"))


def below_reorder_point(policy: DataFrame, current: DataFrame) -> DataFrame:
    """Reorder points beside today's shelf; ``current`` holds one row per position."""
    return policy.join(current.select("store_id", "sku_uid", "stock_on_hand", "cover_days_now"), ["store_id", "sku_uid"]).withColumn(
        "below_reorder_point", F.col("stock_on_hand") <= F.col("recommended_reorder_point")
    )


def policy_frontier(latest: DataFrame, lead_mean: Column, lead_std: Column, dispersion: Column, levels: list[float]) -> DataFrame:
    """Total and mean reorder points at several service levels."""
    out = None
    for level in levels:
        row = reorder_from_demand(latest, lead_mean, lead_std, dispersion, level).agg(
            F.lit(level).alias("service_level"), F.count("*").alias("positions"), F.sum("recommended_reorder_point").alias("total_points"),
            F.avg("recommended_reorder_point").alias("mean_point"), F.avg("recommended_cover_days").alias("mean_cover_days"),
        )
        out = row if out is None else out.unionByName(row)
    return out
