"""Which lever to pull for a position, if any: donors, feasibility, value, decision."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan import params as P
from shelfspan.operators.project import PAIR, summarise_paths
from shelfspan.operators.selection import exact_medians
from shelfspan.session import cut_lineage

LEVERS = [P.REBALANCE, P.EXPEDITE_DC, P.EXPEDITE_SUPPLIER]
SCOPES = {"same_city": "city_norm", "same_zone": "zone_norm", "any": None}

# counts per first-out day of positions carrying committed_units, lead_mean, lead_sigma and arm
Projector = Callable[[DataFrame, list[str]], DataFrame]


def scope_of(frame: DataFrame, stores: DataFrame, scope: str) -> DataFrame:
    column = SCOPES.get(scope, "zone_norm")
    if column is None:
        return frame.withColumn("scope_key", F.lit("ALL"))
    places = stores.groupBy("store_id").agg(F.coalesce(F.min(column), F.lit("")).alias("scope_key"))
    return frame.join(places, "store_id", "left").withColumn("scope_key", F.coalesce("scope_key", F.lit("")))


def find_donors(positions: DataFrame, panel: DataFrame, stores: DataFrame, as_of: Column, scope: str = "same_zone",
                min_cover_days: float = P.MIN_DONOR_COVER_DAYS) -> DataFrame:
    """Stores whose stock exceeds their own requirement by at least one unit."""
    today = panel.filter(F.col("date") == as_of).groupBy(*PAIR).agg(F.coalesce(F.min("store_stock"), F.lit(0.0)).alias("stock"))
    rates = positions.groupBy(*PAIR).agg(F.max("trailing_demand_rate").alias("rate"))
    usual = F.lit(exact_medians(positions, {"m": F.col("trailing_demand_rate")})["m"]).cast("double")
    kept = F.coalesce("rate", usual) * min_cover_days
    surplus = today.join(rates, PAIR, "left").withColumn("donor_surplus", F.greatest(F.col("stock") - kept, F.lit(0.0)))
    placed = scope_of(surplus.filter("donor_surplus >= 1"), stores, scope)
    return placed.select("sku_uid", F.col("store_id").alias("donor_store"), "donor_surplus", "scope_key")


def serving_context(positions: DataFrame, lanes: DataFrame, pending: DataFrame) -> DataFrame:
    """The store's DC, and per SKU the open purchase units and their first vendor."""
    serving = lanes.filter(F.col("dc_id").isNotNull()).groupBy("store_id").agg(F.min("dc_id").alias("dc_id"))
    open_po = pending.groupBy("sku_uid").agg(F.sum("quantity").alias("open_po_units"), F.min("vendor_id").alias("vendor_id"))
    return positions.join(serving, "store_id", "left").join(open_po, "sku_uid", "left").withColumn(
        "open_po_units", F.coalesce("open_po_units", F.lit(0.0))
    )


def feasibility(positions: DataFrame, donors: DataFrame, stores: DataFrame, scope: str = "same_zone", levers: DataFrame | None = None) -> DataFrame:
    """Units and days per lever; the best donor in scope is offered unless it is the store itself.

    ``levers`` optionally holds ``kind`` (dc or vendor), ``id`` and ``expedite_days``.
    """
    best = donors.groupBy("sku_uid", "scope_key").agg(
        F.min(F.struct((-F.col("donor_surplus")).alias("less"), F.col("donor_store").alias("store"))).alias("_best")
    )
    out = scope_of(positions, stores, scope).join(best, ["sku_uid", "scope_key"], "left")
    other = F.col("_best").isNotNull() & (F.col("_best.store") != F.col("store_id"))
    have = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) if c in positions.columns else F.lit(0.0)
    out = out.withColumns({
        "rebalance_units": F.when(other, -F.col("_best.less")).otherwise(0.0), "rebalance_donor": F.when(other, F.col("_best.store")).otherwise(""),
        "rebalance_days": F.lit(P.TRANSFER_LEAD_DAYS), "dc_available": have("dc_stock_for_sku"), "supplier_available": have("open_po_units"),
    }).drop("_best")
    for kind, key, name, fallback in (("dc", "dc_id", "expedite_dc_days", P.DC_EXPEDITE_FALLBACK_DAYS),
                                      ("vendor", "vendor_id", "expedite_supplier_days", P.VENDOR_EXPEDITE_FALLBACK_DAYS)):
        if levers is None or key not in positions.columns:
            out = out.withColumn(name, F.lit(fallback))
            continue
        days = levers.filter(F.col("kind") == kind).groupBy(F.col("id").alias(key)).agg(F.min("expedite_days").cast("double").alias(name))
        out = out.join(days, key, "left").withColumn(name, F.coalesce(name, F.lit(fallback)))
    return out


def lever_values(feasible: DataFrame, project: Projector, horizon: int, unit_costs: dict[str, float] | None = None,
                 margin: float = P.MARGIN_RATE) -> DataFrame:
    """Baseline loss, and units saved and net value per lever, from one stacked projection.

    A lever replaces the committed units of its arm, moves no more than the horizon can
    use, and lands at the mean lead time over all positions.
    """
    costs = {**P.LEVER_COSTS, **(unit_costs or {})}
    columns = {P.REBALANCE: ("rebalance_units", "rebalance_days"), P.EXPEDITE_DC: ("dc_available", "expedite_dc_days"),
               P.EXPEDITE_SUPPLIER: ("supplier_available", "expedite_supplier_days")}
    base, price = cut_lineage(feasible), F.lit(1.0)
    if "avg_price" in base.columns:
        price = F.coalesce("avg_price", F.lit(exact_medians(base, {"m": F.col("avg_price")})["m"]).cast("double"))
    need = F.ceil(F.greatest(F.col("trailing_demand_rate") * horizon - F.col("start_stock"), F.lit(0.0)))
    base = base.withColumns({
        "_price": price, **{f"_moved_{n}": F.least(F.greatest(F.col(u), F.lit(0.0)), need.cast("double")) for n, (u, _) in columns.items()}
    })
    arms = [F.struct(F.lit("baseline").alias("arm"), F.col("committed_units"), F.col("lead_mean"), F.col("lead_sigma"))]
    for name, (_, days) in columns.items():
        mean_days = base.agg(F.avg(days).alias("d")).scalar()
        arms.append(F.struct(F.lit(name).alias("arm"), F.col(f"_moved_{name}").alias("committed_units"), mean_days.alias("lead_mean"),
                             F.lit(P.LEVER_LEAD_SIGMA).alias("lead_sigma")))
    kept = [c for c in base.columns if c not in ("committed_units", "lead_mean", "lead_sigma")]
    stacked = base.select(*kept, F.inline(F.array(*arms)))
    keys = [*PAIR, "arm"]
    loss = summarise_paths(project(stacked, keys), keys, horizon).select(*keys, "mc_expected_days_out")
    wide = loss.groupBy(*PAIR).agg(*[F.max(F.when(F.col("arm") == a, F.col("mc_expected_days_out"))).alias(f"_out_{a}") for a in ["baseline", *LEVERS]])
    out = base.join(wide, PAIR).withColumn("_loss", F.col("_out_baseline") * F.col("trailing_demand_rate"))
    for name in LEVERS:
        moved = F.col(f"_moved_{name}")
        saved = F.when(moved > 0, F.greatest(F.col("_loss") - F.col(f"_out_{name}") * F.col("trailing_demand_rate"), F.lit(0.0))).otherwise(0.0)
        out = out.withColumn(f"_saved_{name}", saved).withColumn(
            f"_value_{name}", F.when(moved > 0, F.col(f"_saved_{name}") * F.col("_price") * margin - moved * costs[name])
        )
    return out


def recommend(valued: DataFrame, margin: float = P.MARGIN_RATE) -> DataFrame:
    """The most valuable lever that beats doing nothing; on a tie the earlier one stays."""
    action, value, saved = F.lit(P.NO_ACTION), F.lit(0.0), F.lit(0.0)
    for name in LEVERS:
        wins = F.coalesce(F.col(f"_value_{name}") > value, F.lit(False))
        action, saved = F.when(wins, F.lit(name)).otherwise(action), F.when(wins, F.col(f"_saved_{name}")).otherwise(saved)
        value = F.when(wins, F.col(f"_value_{name}")).otherwise(value)
    # float noise is settled before halves are rounded
    settled = lambda c: F.round(F.round(c, 9), 2)
    out = valued.withColumns({
        "baseline_expected_lost_units": settled(F.col("_loss")), **{f"{n}_value": settled(F.col(f"_value_{n}")) for n in LEVERS},
        "recommended_action": action, "expected_units_saved": settled(saved), "expected_net_value": settled(value),
        "expected_margin_protected": settled(saved * F.col("_price") * margin),
    })
    donor = F.when(F.col("recommended_action") == P.REBALANCE, F.col("rebalance_donor")).otherwise("")
    return out.withColumn("rebalance_donor", donor).drop(*[c for c in out.columns if c.startswith("_")])


def action_mix(recommendations: DataFrame) -> DataFrame:
    total = recommendations.agg(F.count("*").alias("n")).scalar()
    return recommendations.groupBy("recommended_action").agg(
        F.count("*").alias("positions"), F.sum("expected_units_saved").alias("units_saved"), F.sum("expected_net_value").alias("net_value"),
        F.sum("expected_margin_protected").alias("margin_protected"),
    ).withColumn("share", F.round(F.col("positions") / total, 3))


def decision_backtest(recommendations: DataFrame, truth: DataFrame) -> DataFrame:
    """Did acting land on the positions that ran out?"""
    both = recommendations.join(truth, PAIR).select(
        (F.col("recommended_action") != P.NO_ACTION).cast("int").alias("acted"), F.col("actual_days_to_stockout").isNotNull().cast("int").alias("out")
    )
    return both.agg(
        F.count("*").alias("n"), F.avg("acted").alias("acted_share"), F.avg(F.when(F.col("acted") == 1, F.col("out"))).alias("precision"),
        F.avg(F.when(F.col("out") == 1, F.col("acted"))).alias("recall"), F.avg(F.when(F.col("acted") == 0, F.col("out"))).alias("stockout_rate_when_not"),
        F.avg("out").alias("base_rate"),
    ).withColumn("stockout_rate_when_acted", F.col("precision"))


def _at_risk_with_donors(banded: DataFrame, donors: DataFrame, stores: DataFrame, scope: str) -> DataFrame:
    """High-risk positions with how many other stores could give the SKU, and how much.

    Donors are added up per SKU and scope, and the store's own surplus is taken off again,
    so a position meets one row however many donors there are.
    """
    at_risk = scope_of(banded.filter(F.col("risk_band").isin("Critical", "High")), stores, scope)
    key = ["sku_uid", "scope_key"]
    offered = donors.groupBy(*key).agg(F.count("*").alias("_all"), F.sum("donor_surplus").alias("_units"))
    own = donors.groupBy(*key, F.col("donor_store").alias("store_id")).agg(F.count("*").alias("_own"), F.sum("donor_surplus").alias("_own_units"))
    less = lambda c, d: F.col(c) - F.coalesce(F.col(d), F.lit(0))
    return at_risk.join(offered, key).join(own, [*key, "store_id"], "left").withColumns(
        {"donors": less("_all", "_own"), "donor_units": less("_units", "_own_units")}
    ).drop("_all", "_own", "_units", "_own_units").filter("donors > 0")


def imbalance_totals(banded: DataFrame, donors: DataFrame, stores: DataFrame, scope: str = "same_zone") -> DataFrame:
    """How many pairs of a high-risk position and another store's surplus there are, and their units."""
    found = _at_risk_with_donors(banded, donors, stores, scope)
    return found.agg(F.coalesce(F.sum("donors"), F.lit(0)).alias("positions"), F.sum("donor_units").alias("surplus"))


def imbalance(banded: DataFrame, donors: DataFrame, stores: DataFrame, scope: str = "same_zone", top: int = 40) -> DataFrame:
    """High-risk positions with a donor of the same SKU in scope, the dearest first.

    Every position that stays has a donor, so the first ``top`` rows come from the first
    ``top`` positions; of each SKU and scope they ask for, ``top`` + 1 donors are enough,
    as one of them may be the store itself.
    """
    dearest = [F.desc("expected_lost_revenue"), *PAIR]
    first = _at_risk_with_donors(banded, donors, stores, scope).select(*PAIR, "scope_key", "expected_lost_revenue").orderBy(*dearest).limit(top)
    asked = first.select("sku_uid", "scope_key").distinct()
    largest = Window.partitionBy("sku_uid", "scope_key").orderBy(F.desc("donor_surplus"), "donor_store")
    # at most ``top`` rows are broadcast
    able = donors.join(F.broadcast(asked), ["sku_uid", "scope_key"], "left_semi").withColumn("_place", F.row_number().over(largest)).filter(F.col("_place") <= top + 1)
    pairs = able.join(F.broadcast(first), ["sku_uid", "scope_key"]).filter("donor_store <> store_id")
    found = pairs.select(*PAIR, "donor_store", F.col("donor_surplus").alias("surplus"), "expected_lost_revenue")
    return found.orderBy(*dearest, F.desc("surplus"), "donor_store").limit(top)


def alerts(banded: DataFrame, short: DataFrame, vendors: DataFrame, imbalances: DataFrame, lead: DataFrame) -> DataFrame:
    """One row per rule that fires, by severity and then by what is at stake."""
    parts = []
    for h, severity in zip(P.HORIZONS, ("critical", "warning", "info")):
        risky = banded.filter(F.col(f"p_stockout_{h}d") >= 0.5)
        parts.append(risky.agg(F.lit(severity).alias("severity"), F.lit(f"likely_out_{h}d").alias("rule"), F.count("*").alias("positions"),
                               F.sum("expected_lost_revenue").alias("metric")).filter("positions > 0"))
    parts.append(banded.agg(F.lit("critical").alias("severity"), F.lit("largest_exposure").alias("rule"), F.least(F.count("*"), F.lit(1)).alias("positions"),
                            F.max("expected_lost_revenue").alias("metric")).filter("positions > 0"))
    high = short.filter(F.col("risk_band").isin("Critical", "High"))
    parts.append(high.agg(F.lit("warning").alias("severity"), F.lit("inbound_shortfall").alias("rule"), F.count("*").alias("positions"),
                          F.sum("expected_lost_revenue").alias("metric")).filter("positions > 0"))
    worst = vendors.agg(F.min_by(F.struct("on_time_rate", "receipts"), F.struct("on_time_rate", "vendor")).alias("w")).filter("w.on_time_rate < 0.9")
    parts.append(worst.select(F.lit("warning").alias("severity"), F.lit("late_vendor").alias("rule"), F.lit(1).cast("bigint").alias("positions"),
                              F.col("w.receipts").cast("double").alias("metric")))
    parts.append(imbalances.select(F.lit("warning").alias("severity"), F.lit("imbalance").alias("rule"), "positions",
                                   F.col("surplus").alias("metric")).filter("positions > 0"))
    spread = F.col("std") / F.greatest("mean", F.lit(1e-6))
    parts.append(lead.filter(spread > 0.3).select(F.lit("info").alias("severity"), F.lit("lead_time_spread").alias("rule"),
                                                  F.col("n").alias("positions"), spread.alias("metric")))
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(order, F.desc("metric"))


def feed_totals(recommendations: DataFrame) -> DataFrame:
    acted = F.col("recommended_action") != P.NO_ACTION
    return recommendations.agg(
        F.count("*").alias("total"), F.avg((~acted).cast("int")).alias("no_action_share"),
        F.sum(F.when(acted, F.col("expected_net_value")).otherwise(0.0)).alias("total_net_value"),
    )


FEED_KEY = ["expected_net_value", *PAIR]


def feed_page(recommendations: DataFrame, size: int, after: tuple | None = None, action: str | None = None, store_id: str | None = None,
              sku_uid: str | None = None, min_value: float | None = None) -> DataFrame:
    """``size`` rows of the action feed, the most valuable first, behind the row with key ``after``.

    A page starts behind a key (value, store, SKU), not at an offset: only rows that can be
    on it are kept, so the tenth page costs what the first does, and rows that appear
    meanwhile shift nothing.
    """
    rows = recommendations
    for column, wanted in (("recommended_action", action), ("store_id", store_id), ("sku_uid", sku_uid)):
        rows = rows if wanted is None else rows.filter(F.col(column) == wanted)
    rows = rows if min_value is None else rows.filter(F.col("expected_net_value") >= min_value)
    if after is not None:
        value, store, sku = (F.lit(v) for v in after)
        later = (F.col("store_id") > store) | ((F.col("store_id") == store) & (F.col("sku_uid") > sku))
        rows = rows.filter((F.col("expected_net_value") < value) | ((F.col("expected_net_value") == value) & later))
    return rows.orderBy(F.desc("expected_net_value"), *PAIR).limit(size)


def page_end(page: DataFrame) -> tuple | None:
    """The key of a page's last row, for the page behind it."""
    last = page.orderBy(F.col("expected_net_value"), *[F.desc(c) for c in PAIR]).select(*FEED_KEY).first()
    return None if last is None else tuple(last)


def beside_standing(standing: DataFrame, scenario: DataFrame) -> DataFrame:
    """Each position's standing advice and the scenario's, and what changes between them."""
    kept = ["recommended_action", "rebalance_donor", "expected_units_saved", "expected_net_value"]
    sides = [df.select(*PAIR, *[F.col(c).alias(f"{side}_{c}") for c in kept]) for side, df in (("standing", standing), ("scenario", scenario))]
    both = sides[0].join(sides[1], PAIR, "full")
    change = F.coalesce("scenario_expected_net_value", F.lit(0.0)) - F.coalesce("standing_expected_net_value", F.lit(0.0))
    differs = ~F.col("standing_recommended_action").eqNullSafe(F.col("scenario_recommended_action"))
    return both.withColumns({"changed": differs, "value_change": F.round(change, 2)})


def scenario_delta(compared: DataFrame) -> DataFrame:
    """The scenario's totals beside the standing ones for the same positions, one row."""
    here = compared.filter(F.col("scenario_recommended_action").isNotNull())
    out = [F.count("*").alias("positions"), F.count_if("changed").alias("changed"), F.sum("value_change").alias("value_change")]
    for side in ("standing", "scenario"):
        action, value = F.col(f"{side}_recommended_action"), F.col(f"{side}_expected_net_value")
        idle = (action == P.NO_ACTION).cast("int")
        out += [F.avg(idle).alias(f"{side}_no_action_share"), F.sum(F.when(action != P.NO_ACTION, value).otherwise(0.0)).alias(f"{side}_net_value")]
    return here.agg(*out)
