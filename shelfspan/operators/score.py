"""Scoring open positions: conditional risk, expected loss, ranks, bands, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan import params as P
from shelfspan.functions import normal
from shelfspan.functions.values import clip
from shelfspan.operators.ordering import place, rank_all
from shelfspan.operators.selection import exact_medians

SURVIVED_FLOOR = 1e-9
REPORT = [
    "as_of", "store_id", "sku_uid", "category", "size_label", "start_stock", "days_of_cover", "trailing_demand_rate",
    "elapsed_days", "p_stockout_7d", "p_stockout_14d", "p_stockout_28d", "expected_days_out", "expected_lost_units",
    "expected_lost_revenue", "rank_by_risk", "rank_by_units", "rank_by_revenue", "predicted_median_days",
    "driver_1", "driver_1_effect", "driver_2", "driver_2_effect", "driver_3", "driver_3_effect",
]


def _placed(frame: DataFrame, model) -> DataFrame:
    """Linear predictor and survival so far, floored."""
    so_far = normal.standardised(F.col("elapsed_days").cast("double"), F.col("_mu"), model.sigma)
    return frame.withColumn("_mu", model.mu()).withColumn("_z0", so_far).withColumn(
        "_start", F.greatest(normal.cdf(-F.col("_z0")), F.lit(SURVIVED_FLOOR))
    )


def _lost(z: Column) -> Column:
    """Chance of having run out by then, given survival so far."""
    return clip(1 - normal.cdf(-z) / F.col("_start"), 0.0, 1.0)


def _ahead(model, days: Column) -> Column:
    return normal.standardised(F.col("elapsed_days") + days, F.col("_mu"), model.sigma)


def conditional_risk(frame: DataFrame, model, horizons=P.HORIZONS) -> DataFrame:
    placed = _placed(frame, model).withColumns({f"_z{h}": _ahead(model, F.lit(float(h))) for h in horizons})
    risks = placed.withColumns({f"p_stockout_{h}d": _lost(F.col(f"_z{h}")) for h in horizons})
    return risks.drop("_mu", "_start", "_z0", *[f"_z{h}" for h in horizons])


def expected_days_out(frame: DataFrame, model, horizon: int) -> DataFrame:
    """Days expected without stock over the horizon if nothing arrives."""
    days = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda u: _ahead(model, u.cast("double")))
    total = F.aggregate(days, F.lit(0.0), lambda acc, z: acc + _lost(z))
    return _placed(frame, model).withColumn("expected_days_out", total).drop("_mu", "_start", "_z0")


def rank_positions(frame: DataFrame, model, horizon: int = 14, horizons=P.HORIZONS) -> DataFrame:
    """Risk, expected loss in units and money, and the three ranks."""
    scored = expected_days_out(conditional_risk(frame, model, horizons), model, horizon)
    price = F.coalesce("avg_price", F.lit(exact_medians(frame, {"m": F.col("avg_price")})["m"]).cast("double"))
    lost = scored.withColumn("expected_lost_units", F.col("expected_days_out") * F.greatest("trailing_demand_rate", F.lit(0.0)))
    lost = lost.withColumn("expected_lost_revenue", F.col("expected_lost_units") * price)
    return rank_all(lost, {
        "rank_by_risk": (f"p_stockout_{horizon}d", True, "min"), "rank_by_units": ("expected_lost_units", True, "min"),
        "rank_by_revenue": ("expected_lost_revenue", True, "min"),
    })


def with_shelf_today(scored: DataFrame, panel: DataFrame, as_of: Column) -> DataFrame:
    """Stock on the scoring day (the opening stock where the day is missing) and today's cover."""
    today = panel.filter(F.col("date") == as_of).groupBy("store_id", "sku_uid").agg(F.min("store_stock").alias("_today"))
    on_hand = F.greatest(F.coalesce("_today", "start_stock"), F.lit(0.0))
    return scored.join(today, ["store_id", "sku_uid"], "left").withColumn("stock_on_hand", on_hand).withColumn(
        "cover_days_now", F.round(F.col("stock_on_hand") / F.greatest("trailing_demand_rate", F.lit(0.01)), 2)
    ).drop("_today")


def attach_bands(scored: DataFrame, horizon: int = 14) -> DataFrame:
    """Likelihood and consequence together; money thresholds are quantiles of the population."""
    filled = scored.withColumns({
        "_p": F.coalesce(f"p_stockout_{horizon}d", F.lit(0.0)), "_v": F.coalesce("expected_lost_revenue", F.lit(0.0)),
    })
    placed = place(filled, ["_v"])
    marks = placed.quantiles({"dear": ("_v", P.EXPENSIVE_QUANTILE), "note": ("_v", P.NOTABLE_QUANTILE)})
    ranked = placed.ranked({"_rank": ("_v", False, "pct")})
    dear, notable = (F.col("_v") >= F.lit(marks[m]).cast("double") for m in ("dear", "note"))
    likely, possible = F.col("_p") >= P.LIKELY, F.col("_p") >= P.POSSIBLE
    band = (
        F.when(likely & dear, "Critical").when(likely | (possible & dear), "High").when(possible | notable, "Medium").otherwise("Low")
    )
    return ranked.withColumns({
        "risk_band": band, "risk_score": F.round(100 * (0.6 * F.col("_p") + 0.4 * F.col("_rank")), 1),
    }).drop("_p", "_v", "_rank")


def band_summary(banded: DataFrame) -> DataFrame:
    """All four bands, empty ones included."""
    rows = [banded.select(F.col("risk_band").alias("band"), F.lit(1).alias("k"), "expected_lost_units", "expected_lost_revenue")]
    rows += [banded.agg(F.lit(b).alias("band"), F.lit(0).alias("k"), F.lit(0.0).alias("expected_lost_units"),
                        F.lit(0.0).alias("expected_lost_revenue")) for b in P.BANDS]
    return reduce(lambda a, b: a.unionByName(b), rows).groupBy("band").agg(
        F.sum("k").alias("positions"), F.round(F.sum("expected_lost_units"), 1).alias("lost_units"),
        F.round(F.sum("expected_lost_revenue"), 0).alias("lost_revenue"),
    )


def coverage_short(frame: DataFrame) -> DataFrame:
    """Committed stock does not cover the next two weeks of demand."""
    on_hand = F.col("stock_on_hand" if "stock_on_hand" in frame.columns else "start_stock")
    need = F.col("trailing_demand_rate") * P.SHORTFALL_DAYS - on_hand
    return frame.filter((need > 0) & (F.coalesce("intransit_units", F.lit(0.0)) < need))


def filter_positions(frame: DataFrame, band=None, store_id=None, category=None, horizon: int = 14,
                     min_probability: float = 0.0, coverage=None, search=None) -> DataFrame:
    """The shared filters; one without its column is skipped."""
    if band and "risk_band" in frame.columns:
        frame = frame.filter(F.col("risk_band") == band)
    if store_id:
        frame = frame.filter(F.col("store_id") == store_id)
    if category and "category" in frame.columns:
        frame = frame.filter(F.col("category") == category)
    if min_probability > 0 and f"p_stockout_{horizon}d" in frame.columns:
        frame = frame.filter(F.col(f"p_stockout_{horizon}d") >= min_probability)
    if coverage == "short" and "intransit_units" in frame.columns:
        frame = coverage_short(frame)
    if search:
        needle = search.strip().upper()
        frame = frame.filter(F.contains(F.upper("sku_uid"), F.lit(needle)) | F.contains(F.upper("store_id"), F.lit(needle)))
    return frame


def to_report(scored: DataFrame) -> DataFrame:
    digits = {**{c: 2 for c in ("days_of_cover", "trailing_demand_rate", "expected_days_out", "expected_lost_units", "expected_lost_revenue")},
              **{f"p_stockout_{h}d": 4 for h in P.HORIZONS}}
    return scored.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in REPORT if c in scored.columns])


def page(frame: DataFrame, by: str, offset: int, limit: int) -> DataFrame:
    """One page of a list, ties settled by the position's own key."""
    return frame.orderBy(F.desc(by), "store_id", "sku_uid", "spell_id").offset(offset).limit(limit)


def depletion_timeline(positions: DataFrame, days: int = 28) -> DataFrame:
    left = F.greatest(F.col("stock_on_hand") - F.greatest("trailing_demand_rate", F.lit(0.0)) * F.col("day"), F.lit(0.0))
    return positions.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days)))).withColumn("projected_stock", F.round(left, 1))


def kpis(scored: DataFrame, horizons=P.HORIZONS, threshold: float = 0.5) -> DataFrame:
    """Positions and money at risk per horizon, and the totals, in one pass."""
    at_risk = {h: F.col(f"p_stockout_{h}d") >= threshold for h in horizons}
    money = F.coalesce("expected_lost_revenue", F.lit(0.0))
    return scored.agg(
        F.count("*").alias("positions_open"), F.count_if(F.col("risk_band").isin("Critical", "High")).alias("skus_at_risk"),
        *[F.count_if(c).alias(f"positions_{h}d") for h, c in at_risk.items()],
        *[F.sum(F.when(c, money).otherwise(0.0)).alias(f"revenue_{h}d") for h, c in at_risk.items()],
        F.sum(money).alias("inventory_value_at_risk"),
    )


def topology(scored: DataFrame, snapshot: DataFrame, stores: DataFrame, serving: DataFrame) -> DataFrame:
    """Store nodes: positions, high-risk count, exposure, stock on hand and the serving DC."""
    risk = scored.groupBy("store_id").agg(
        F.count("*").alias("positions"), F.count_if(F.col("risk_band").isin("Critical", "High")).alias("at_risk"),
        F.sum("expected_lost_revenue").alias("exposure"),
    )
    stock = snapshot.groupBy("store_id").agg(F.sum("store_stock").alias("on_hand"))
    return (
        risk.join(stock, "store_id", "left").join(stores, "store_id", "left").join(serving, "store_id", "left")
        .withColumn("on_hand", F.coalesce("on_hand", F.lit(0.0)))
    )


def dc_nodes(store_nodes: DataFrame) -> DataFrame:
    return store_nodes.filter(F.col("dc_id").isNotNull()).groupBy("dc_id").agg(
        F.count("*").alias("stores"), F.sum("positions").alias("positions"), F.sum("at_risk").alias("at_risk")
    )


def largest_per_group(frame: DataFrame, group: list[str], by: str, n: int, tie: list[str]) -> DataFrame:
    place = Window.partitionBy(*group).orderBy(F.desc(by), *tie)
    return frame.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= n).drop("_n")
