"""Projection and prescription over a draw table both engines compute alike.

A draw is whole-number arithmetic on position, path, day and arm; the negative binomial
projection itself runs in ``project_paths`` and ``recommend_drawn`` without an oracle.
"""

from pyspark.sql import functions as F

from parity.base import cte, query
from parity.feature_queries import modeled
from parity.rollup_queries import as_of, leads
from parity.score_queries import banded, shelf
from shelfspan import params as P
from shelfspan.operators import panel as panel_ops
from shelfspan.operators import prescribe as X
from shelfspan.operators import project as J
from shelfspan.operators import rollups as R
from shelfspan.operators import spells as S
from shelfspan.session import cut_lineage
from shelfspan.sources.extract import lead_columns

PAIR = ["store_id", "sku_uid"]
H, PATHS = 14, 20
ARMS = {"baseline": 0, P.REBALANCE: 1, P.EXPEDITE_DC: 2, P.EXPEDITE_SUPPLIER: 3}


def draws(positions, keys, horizon=H, n_paths=PATHS, arm=None):
    """Demand and landing per position and path, as arrays by day."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    pid = number("store_id") * 2 + number("sku_uid")
    shift = F.lit(0) if arm is None else F.when(F.col(arm) == "baseline", 0).otherwise(1)
    # the draws are heavy and the positions light, so the task count is set here rather than by input size
    dealt = positions.repartition(int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    spread = dealt.withColumns({"_pid": pid, "_shift": shift, "path": F.explode(F.sequence(F.lit(1), F.lit(n_paths)))})
    u = lambda day: (F.col("_pid") * 7919 + F.col("path") * 104729 + day * 1299709 + F.col("_shift") * 15485863) % 10007 / 10007.0
    arrival = 1 + (F.col("_pid") * 31 + F.col("path") * 17) % (horizon + 1)
    arrival = arrival if arm is None else F.when(F.col(arm) == "baseline", arrival).otherwise(F.rint("lead_mean"))
    days = [F.lit(day) for day in range(1, horizon + 1)]
    return spread.withColumn("_arrival", arrival).select(
        *keys, "path", F.col("start_stock"), F.array(*[F.when(day == F.col("_arrival"), F.col("committed_units")).otherwise(0.0) for day in days]).alias("landing"),
        F.array(*[F.floor(u(day) * 3 * F.col("trailing_demand_rate") + 0.25).cast("double") for day in days]).alias("demand"))


def scoring_day(feed):
    """Read once: it filters several reads of the panel."""
    if "_scoring_day" not in feed.__dict__:
        feed._scoring_day = panel_ops.latest_backtest_date(feed.settled().ledger, H).first()["as_of"]
    return F.lit(feed._scoring_day).cast("date")


def past_positions(feed, day=None):
    """The open positions of a day, written once however many queries' parts ask for them."""
    feed = feed.settled()
    if day is None and "_past_positions" in feed.__dict__:
        return feed._past_positions
    frame = modeled(feed, ["trailing_demand_rate", "days_of_cover", "avg_price", "intransit_units"])
    past = S.latest_position(S.open_positions(frame, scoring_day(feed) if day is None else day))
    built = cut_lineage(J.build_positions(past, feed.ledger_with_inbound, scoring_day(feed) if day is None else day))
    if day is None:
        feed._past_positions = built
    return built


def past_cte(name, day):
    cte(name, f"""
SELECT m.store_id, m.sku_uid, user_id * 2 + part AS pid, greatest(coalesce(today, start_stock), 0) AS start_stock, trailing_demand_rate, avg_price, greatest(coalesce(moving, 0), 0) AS committed_units
FROM (SELECT * FROM model_frame, ({day}) WHERE spell_start <= a AND spell_end >= a
      QUALIFY row_number() OVER (PARTITION BY store_id, sku_uid ORDER BY spell_start DESC) = 1) m
LEFT JOIN (SELECT store_id AS s, sku_uid AS k, date AS d, store_stock AS today, CAST(inbound AS DOUBLE) AS moving FROM panel) t ON t.s = m.store_id AND t.k = m.sku_uid AND t.d = m.a
""")


past_cte("past_rows", "SELECT max(date) - 14 AS a FROM panel")
POSITION = "store_id:s sku_uid:s start_stock:f trailing_demand_rate:f committed_units:f"


@query("build_positions", POSITION, "SELECT * FROM past_rows")
def _build(feed):
    return past_positions(feed)


def draw_ctes(prefix, rows, extra, arrival, shift):
    cte(f"{prefix}_draws", f"""
SELECT store_id, sku_uid{extra}, path, day, start_stock, CASE WHEN day = {arrival} THEN committed_units ELSE 0 END AS landing,
       floor((pid * 7919 + path * 104729 + day * 1299709 + {shift} * 15485863) % 10007 / 10007.0 * 3 * trailing_demand_rate + 0.25) AS demand
FROM {rows}, (SELECT unnest(generate_series(1, {PATHS})) AS path), (SELECT unnest(generate_series(1, {H})) AS day)
""")
    cte(f"{prefix}_free", f"""
SELECT *, start_stock + sum(landing - demand) OVER (PARTITION BY store_id, sku_uid{extra}, path ORDER BY day) AS free FROM {prefix}_draws
""")
    cte(f"{prefix}_paths", f"""
SELECT *, free - least(0, min(free) OVER (PARTITION BY store_id, sku_uid{extra}, path ORDER BY day)) AS level FROM {prefix}_free
""")
    cte(f"{prefix}_first", f"""
SELECT store_id, sku_uid{extra}, path, coalesce(min(CASE WHEN level <= 0 THEN day END), {H + 1}) AS first_out FROM {prefix}_paths GROUP BY ALL
""")
    cte(f"{prefix}_sum", f"""
SELECT *, CASE WHEN mc_p_stockout >= 0.1 THEN q10 END AS mc_days_to_stockout_p10, CASE WHEN mc_p_stockout >= 0.5 THEN q50 END AS mc_days_to_stockout_p50,
       CASE WHEN mc_p_stockout >= 0.9 THEN q90 END AS mc_days_to_stockout_p90 FROM (
SELECT store_id, sku_uid{extra}, avg(CASE WHEN first_out <= {H} THEN 1.0 ELSE 0.0 END) AS mc_p_stockout, avg(CASE WHEN first_out <= 7 THEN 1.0 ELSE 0.0 END) AS mc_p_stockout_7d,
       quantile_cont(first_out, 0.1) FILTER (WHERE first_out <= {H}) AS q10, quantile_cont(first_out, 0.5) FILTER (WHERE first_out <= {H}) AS q50,
       quantile_cont(first_out, 0.9) FILTER (WHERE first_out <= {H}) AS q90, avg(CASE WHEN first_out <= {H} THEN {H} - first_out + 1 ELSE 0 END) AS mc_expected_days_out
FROM {prefix}_first GROUP BY ALL)
""")


draw_ctes("one", "past_rows", "", f"1 + (pid * 31 + path * 17) % {H + 1}", "0")


def paths(feed, **change):
    positions = past_positions(feed).withColumns(change)
    return J.paths_from_draws(draws(positions, PAIR), PAIR)


def counts(feed, **change):
    return J.first_out_counts(paths(feed, **change), PAIR, H)


@query("project_draws", "store_id:s sku_uid:s first_out:i paths:i", "SELECT store_id, sku_uid, first_out, count(*) AS paths FROM one_first GROUP BY 1, 2, 3")
def _project(feed):
    return counts(feed)


@query("stock_fan", "store_id:s sku_uid:s day:i p10_stock:f p50_stock:f p90_stock:f", """
SELECT store_id, sku_uid, day, quantile_cont(level, 0.1) AS p10_stock, quantile_cont(level, 0.5) AS p50_stock, quantile_cont(level, 0.9) AS p90_stock FROM one_paths GROUP BY 1, 2, 3
""")
def _fan(feed):
    by_day = paths(feed).select(*PAIR, "path", F.posexplode("stock").alias("day", "stock"))
    return J.stock_fan(by_day.withColumn("day", F.col("day") + 1), PAIR)


SUMMARY = "store_id:s sku_uid:s mc_p_stockout:f mc_p_stockout_7d:f mc_days_to_stockout_p10:f mc_days_to_stockout_p50:f mc_days_to_stockout_p90:f mc_expected_days_out:f"


@query("path_summary", SUMMARY, "SELECT * FROM one_sum")
def _summary(feed):
    return J.summarise_paths(counts(feed), PAIR, H)


@query("position_curve", "store_id:s sku_uid:s day:i probability:f", f"""
SELECT store_id, sku_uid, day, avg(CASE WHEN first_out <= day THEN 1.0 ELSE 0.0 END) AS probability FROM one_first, (SELECT unnest(generate_series(0, {H})) AS day) GROUP BY 1, 2, 3
""")
def _curve(feed):
    return J.position_curve(counts(feed), PAIR, H)


@query("first_out_histogram", "store_id:s sku_uid:s first_out:i paths:i share:f", f"""
SELECT store_id, sku_uid, first_out, count(*) AS paths, count(*) / {PATHS} AS share FROM one_first WHERE first_out <= {H} GROUP BY 1, 2, 3
""")
def _hist(feed):
    return J.first_out_histogram(counts(feed), PAIR, H)


POPULATION = "positions:i p_stockout_mean:f positions_likely_out:i expected_days_out_mean:f expected_unmet_units:f1"
POPULATION_SQL = """
SELECT count(*) AS positions, avg(mc_p_stockout) AS p_stockout_mean, count(*) FILTER (WHERE mc_p_stockout >= 0.5) AS positions_likely_out,
       avg(mc_expected_days_out) AS expected_days_out_mean, sum(round(CAST(mc_expected_days_out * trailing_demand_rate AS DECIMAL(18, 9)), 1)) AS expected_unmet_units
FROM {sums} JOIN {rows} USING (store_id, sku_uid)"""


def population(feed, **change):
    rates = past_positions(feed).withColumns(change).select(*PAIR, "trailing_demand_rate")
    return J.population_risk(J.summarise_paths(counts(feed, **change), PAIR, H).join(rates, PAIR))


@query("population_risk", POPULATION, POPULATION_SQL.format(sums="one_sum", rows="past_rows"))
def _population(feed):
    return population(feed)


cte("more_rows", "SELECT * REPLACE (trailing_demand_rate * 1.5 AS trailing_demand_rate, 0.0 AS committed_units) FROM past_rows")
draw_ctes("two", "more_rows", "", f"1 + (pid * 31 + path * 17) % {H + 1}", "0")


@query("scenario", "arm:s " + POPULATION, f"""
SELECT 'baseline' AS arm, * FROM ({POPULATION_SQL.format(sums='one_sum', rows='past_rows')}) UNION ALL
SELECT 'scenario', * FROM ({POPULATION_SQL.format(sums='two_sum', rows='more_rows')})
""")
def _scenario(feed):
    changed = {"trailing_demand_rate": F.col("trailing_demand_rate") * 1.5, "committed_units": F.lit(0.0)}
    return population(feed).withColumn("arm", F.lit("baseline")).unionByName(population(feed, **changed).withColumn("arm", F.lit("scenario")))


cte("past_truth", f"""
SELECT r.store_id, r.sku_uid, min(date_diff('day', a, p.date)) AS actual FROM past_rows r CROSS JOIN (SELECT max(date) - {H} AS a FROM panel)
LEFT JOIN panel p ON p.store_id = r.store_id AND p.sku_uid = r.sku_uid AND p.date > a AND p.date <= a + {H} AND p.store_stock <= 0 GROUP BY 1, 2
""")


@query("interval_backtest", "n:i coverage_p10_p90:f breach_below_p10:f breach_above_p90:f median_error_days:f p_stockout_mean:f actual_stockout_rate:f", """
SELECT count(*) FILTER (WHERE ok) AS n, avg(CASE WHEN ok THEN CASE WHEN early OR late THEN 0.0 ELSE 1.0 END END) AS coverage_p10_p90,
       avg(CASE WHEN ok THEN CASE WHEN early THEN 1.0 ELSE 0.0 END END) AS breach_below_p10, avg(CASE WHEN ok THEN CASE WHEN late THEN 1.0 ELSE 0.0 END END) AS breach_above_p90,
       median(CASE WHEN ok THEN mc_days_to_stockout_p50 - actual END) AS median_error_days, avg(mc_p_stockout) AS p_stockout_mean,
       avg(CASE WHEN actual IS NULL THEN 0.0 ELSE 1.0 END) AS actual_stockout_rate
FROM (SELECT *, mc_days_to_stockout_p50 IS NOT NULL AND actual IS NOT NULL AS ok, actual < coalesce(mc_days_to_stockout_p10, 1e9) AS early, actual > coalesce(mc_days_to_stockout_p90, 1e9) AS late
      FROM one_sum JOIN past_truth USING (store_id, sku_uid))
""")
def _intervals(feed):
    positions = past_positions(feed)
    summary = J.summarise_paths(counts(feed), PAIR, H)
    truth = panel_ops.actual_outcomes(feed.ledger, positions.select(*PAIR), scoring_day(feed), H)
    return J.score_against_truth(summary, truth)


def calibrated(feed):
    feed = feed.settled()
    sold = feed.ledger.filter("units_sold > 0")
    return cut_lineage(R.calibrate(feed.ledger, sold, feed.replenishment_orders, feed.forecast, feed.product_dim, min_days=3, min_rows=2))


@query("project_paths", SUMMARY)
def _paths(feed):
    ready = J.with_uncertainty(past_positions(feed), calibrated(feed))
    return J.summarise_paths(J.project_positions(ready, PAIR, H, 200, 7, F.weekday(scoring_day(feed))), PAIR, H)


# --- prescription ----------------------------------------------------------
cte("donor_rows", """
SELECT p.sku_uid, p.store_id AS donor_store, store_stock - coalesce(rate, usual) * 5 AS donor_surplus, zone_norm AS scope_key
FROM (SELECT * FROM panel WHERE date = (SELECT max(date) - 14 FROM panel)) p LEFT JOIN (SELECT store_id AS s, sku_uid AS k, trailing_demand_rate AS rate FROM past_rows) r ON r.s = p.store_id AND r.k = p.sku_uid
CROSS JOIN (SELECT median(trailing_demand_rate) AS usual FROM past_rows) JOIN store_dim s ON s.store_id = p.store_id WHERE store_stock - coalesce(rate, usual) * 5 >= 1
""")


def donors_of(feed, positions, day):
    return X.find_donors(positions, feed.ledger, feed.store_dim, day, min_cover_days=5)


@query("donors", "sku_uid:s donor_store:s donor_surplus:f scope_key:s", "SELECT * FROM donor_rows")
def _donors(feed):
    return donors_of(feed, past_positions(feed), scoring_day(feed))


cte("po", "SELECT sku_uid, sum(quantity) AS open_po_units, min(vendor_id) AS vendor_id FROM pending_orders GROUP BY 1")
cte("best_donor", "SELECT * FROM donor_rows QUALIFY row_number() OVER (PARTITION BY sku_uid, scope_key ORDER BY donor_surplus DESC, donor_store) = 1")
cte("feasible", """
SELECT r.*, dc_id, vendor_id, coalesce(open_po_units, 0) AS supplier_available, CASE WHEN donor_store <> r.store_id THEN donor_surplus ELSE 0 END AS rebalance_units,
       CASE WHEN donor_store <> r.store_id THEN donor_store ELSE '' END AS rebalance_donor, 0.0 AS dc_available,
       CASE dc_id WHEN 'WH_AFRICA' THEN 3 WHEN 'WH_ASIA' THEN 2 ELSE 1 END AS expedite_dc_days, CASE WHEN vendor_id = 'V1' THEN 9 ELSE 20 END AS expedite_supplier_days
FROM past_rows r LEFT JOIN store_dim s ON s.store_id = r.store_id LEFT JOIN po ON po.sku_uid = r.sku_uid LEFT JOIN best_donor b ON b.sku_uid = r.sku_uid AND b.scope_key = s.zone_norm
""")


def feasible(feed):
    positions = past_positions(feed)  # materialised: read by donors and by the context
    ready = X.serving_context(positions, feed.store_dim.select("store_id", "dc_id"), feed.pending_orders)
    levers = feed.spark.createDataFrame([("dc", "WH_AFRICA", 3.0), ("dc", "WH_ASIA", 2.0), ("vendor", "V1", 9.0)], "kind string, id string, expedite_days double")
    return X.feasibility(ready, donors_of(feed, positions, scoring_day(feed)), feed.store_dim, levers=levers)


@query("serving_context", "store_id:s sku_uid:s dc_id:s vendor_id:s open_po_units:f", "SELECT *, supplier_available AS open_po_units FROM feasible")
def _context(feed):
    return X.serving_context(past_positions(feed), feed.store_dim.select("store_id", "dc_id"), feed.pending_orders)


@query("feasibility", "store_id:s sku_uid:s rebalance_units:f rebalance_donor:s supplier_available:f expedite_dc_days:f expedite_supplier_days:f",
       "SELECT * FROM feasible")
def _feasible(feed):
    return feasible(feed)


cte("moved_rows", f"""
SELECT *, least(rebalance_units, need) AS m1, least(supplier_available, need) AS m3
FROM (SELECT *, ceil(greatest(trailing_demand_rate * {H} - start_stock, 0)) AS need FROM feasible)
""")
cte("arm_rows", """
SELECT store_id, sku_uid, pid, 'baseline' AS arm, start_stock, trailing_demand_rate, committed_units, 0 AS lead FROM moved_rows
UNION ALL SELECT store_id, sku_uid, pid, 'rebalance_from_store', start_stock, trailing_demand_rate, m1, 2 FROM moved_rows
UNION ALL SELECT store_id, sku_uid, pid, 'expedite_from_supplier', start_stock, trailing_demand_rate, m3, (SELECT round_even(avg(expedite_supplier_days), 0) FROM feasible) FROM moved_rows
""")
draw_ctes("arm", "arm_rows", ", arm", f"(CASE WHEN arm = 'baseline' THEN 1 + (pid * 31 + path * 17) % {H + 1} ELSE lead END)", "(CASE WHEN arm = 'baseline' THEN 0 ELSE 1 END)")
cte("arm_wide", """
SELECT store_id, sku_uid, max(mc_expected_days_out) FILTER (WHERE arm = 'baseline') AS e0, max(mc_expected_days_out) FILTER (WHERE arm = 'rebalance_from_store') AS e1,
       max(mc_expected_days_out) FILTER (WHERE arm = 'expedite_from_supplier') AS e3 FROM arm_sum GROUP BY 1, 2
""")
cte("valued", """
SELECT *, CASE WHEN m1 > 0 THEN s1 * avg_price * 0.4 - m1 * 40 END AS v1, CASE WHEN m3 > 0 THEN s3 * avg_price * 0.4 - m3 * 60 END AS v3 FROM (
SELECT m.*, e0 * trailing_demand_rate AS loss, CASE WHEN m1 > 0 THEN greatest((e0 - e1) * trailing_demand_rate, 0) ELSE 0 END AS s1, CASE WHEN m3 > 0 THEN greatest((e0 - e3) * trailing_demand_rate, 0) ELSE 0 END AS s3
FROM moved_rows m JOIN arm_wide USING (store_id, sku_uid))
""")
def rec_cte(name, valued, margin):
    cte(name, f"""
SELECT *, round(CAST(loss AS DECIMAL(18, 9)), 2) AS baseline_expected_lost_units, round(CAST(best_saved AS DECIMAL(18, 9)), 2) AS expected_units_saved, round(CAST(best AS DECIMAL(18, 9)), 2) AS expected_net_value, round(CAST(best_saved * avg_price * {margin} AS DECIMAL(18, 9)), 2) AS expected_margin_protected,
       CASE WHEN recommended_action = 'rebalance_from_store' THEN rebalance_donor ELSE '' END AS donor FROM (
SELECT *, CASE WHEN coalesce(v3, -1) > greatest(coalesce(v1, 0), 0) THEN 'expedite_from_supplier' WHEN coalesce(v1, 0) > 0 THEN 'rebalance_from_store' ELSE 'no_action' END AS recommended_action,
       CASE WHEN coalesce(v3, -1) > greatest(coalesce(v1, 0), 0) THEN v3 WHEN coalesce(v1, 0) > 0 THEN v1 ELSE 0 END AS best,
       CASE WHEN coalesce(v3, -1) > greatest(coalesce(v1, 0), 0) THEN s3 WHEN coalesce(v1, 0) > 0 THEN s1 ELSE 0 END AS best_saved FROM {valued})
""")


rec_cte("recs", "valued", 0.4)
cte("what_if_valued", "SELECT * REPLACE (CASE WHEN m1 > 0 THEN s1 * avg_price * 0.3 - m1 * 200 END AS v1, CASE WHEN m3 > 0 THEN s3 * avg_price * 0.3 - m3 * 60 END AS v3) FROM valued")
rec_cte("what_if_recs", "what_if_valued", 0.3)


def by_draws(stacked, keys):
    return J.first_out_counts(J.paths_from_draws(draws(stacked, keys, arm="arm"), keys), keys, H)


def recommended(feed, costs=None, margin=P.MARGIN_RATE):
    ready = feasible(feed).withColumns({"lead_mean": F.lit(0.0), "lead_sigma": F.lit(0.0)})
    valued = X.lever_values(ready, by_draws, H, {P.EXPEDITE_SUPPLIER: 60.0, **(costs or {})}, margin)
    return cut_lineage(X.recommend(valued, margin))


@query("lever_value", "store_id:s sku_uid:s baseline_expected_lost_units:f2 rebalance_from_store_value:f2 expedite_from_supplier_value:f2",
       "SELECT *, round(CAST(v1 AS DECIMAL(18, 9)), 2) AS rebalance_from_store_value, round(CAST(v3 AS DECIMAL(18, 9)), 2) AS expedite_from_supplier_value FROM recs")
def _values(feed):
    return recommended(feed)


@query("recommend", "store_id:s sku_uid:s recommended_action:s rebalance_donor:s expected_units_saved:f2 expected_net_value:f2 expected_margin_protected:f2",
       "SELECT * REPLACE (donor AS rebalance_donor) FROM recs")
def _recommend(feed):
    return recommended(feed)


@query("action_mix", "recommended_action:s positions:i units_saved:f2 net_value:f2 margin_protected:f2 share:f3", """
SELECT recommended_action, count(*) AS positions, sum(expected_units_saved) AS units_saved, sum(expected_net_value) AS net_value, sum(expected_margin_protected) AS margin_protected,
       count(*) / (SELECT count(*) FROM recs) AS share FROM recs GROUP BY 1
""")
def _mix(feed):
    return X.action_mix(recommended(feed))


@query("action_feed", "total:i no_action_share:f total_net_value:f2", """
SELECT count(*) AS total, avg(CASE WHEN recommended_action = 'no_action' THEN 1.0 ELSE 0.0 END) AS no_action_share, sum(expected_net_value) FILTER (WHERE recommended_action <> 'no_action') AS total_net_value
FROM recs
""")
def _feed(feed):
    return X.feed_totals(recommended(feed))


FEED_ROW = "page:i store_id:s sku_uid:s recommended_action:s expected_net_value:f2 expected_units_saved:f2"


@query("action_feed_pages", FEED_ROW, """
SELECT *, CAST((place - 1) // 15 AS BIGINT) AS page FROM (
SELECT *, row_number() OVER (ORDER BY expected_net_value DESC, store_id, sku_uid) AS place FROM recs WHERE recommended_action <> 'no_action') WHERE place <= 30
""")
def _pages(feed):
    """Two pages, the second behind the last row of the first."""
    acted = recommended(feed).filter(F.col("recommended_action") != P.NO_ACTION)
    first = X.feed_page(acted, 15)
    end = X.page_end(first)
    second = X.feed_page(acted, 15, after=end) if end else first.limit(0)
    return first.withColumn("page", F.lit(0)).unionByName(second.withColumn("page", F.lit(1)))


@query("decision_backtest", "n:i acted_share:f precision:f recall:f stockout_rate_when_not:f base_rate:f", """
SELECT count(*) AS n, avg(acted) AS acted_share, avg(ran) FILTER (WHERE acted = 1) AS precision, avg(acted) FILTER (WHERE ran = 1) AS recall, avg(ran) FILTER (WHERE acted = 0) AS stockout_rate_when_not, avg(ran) AS base_rate
FROM (SELECT CASE WHEN recommended_action <> 'no_action' THEN 1.0 ELSE 0.0 END AS acted, CASE WHEN actual IS NULL THEN 0.0 ELSE 1.0 END AS ran FROM recs JOIN past_truth USING (store_id, sku_uid))
""")
def _decisions(feed):
    positions = past_positions(feed)
    truth = panel_ops.actual_outcomes(feed.ledger, positions.select(*PAIR), scoring_day(feed), H)
    return X.decision_backtest(recommended(feed), truth)


COMPARED = """
SELECT store_id, sku_uid, r.recommended_action AS standing_recommended_action, w.recommended_action AS scenario_recommended_action, r.recommended_action <> w.recommended_action AS changed,
       r.expected_net_value AS standing_expected_net_value, w.expected_net_value AS scenario_expected_net_value,
       w.expected_net_value - r.expected_net_value AS value_change FROM recs r JOIN what_if_recs w USING (store_id, sku_uid)"""


def compared(feed):
    return X.beside_standing(recommended(feed), recommended(feed, {P.REBALANCE: 200.0}, 0.3))


@query("scenario_recommend", "store_id:s sku_uid:s standing_recommended_action:s scenario_recommended_action:s changed:i scenario_expected_net_value:f2 value_change:f2", COMPARED)
def _what_if(feed):
    return compared(feed)


@query("scenario_delta", "positions:i changed:i value_change:f2 standing_no_action_share:f standing_net_value:f2 scenario_no_action_share:f scenario_net_value:f2", f"""
SELECT count(*) AS positions, count(*) FILTER (WHERE changed) AS changed, sum(value_change) AS value_change,
""" + ", ".join(f"avg(CASE WHEN {side}_recommended_action = 'no_action' THEN 1.0 ELSE 0.0 END) AS {side}_no_action_share, coalesce(sum({side}_expected_net_value) FILTER (WHERE {side}_recommended_action <> 'no_action'), 0) AS {side}_net_value"
                for side in ("standing", "scenario")) + f" FROM ({COMPARED})")
def _delta(feed):
    return X.scenario_delta(compared(feed))


@query("recommend_drawn", "recommended_action:s positions:i")
def _drawn(feed):
    ready = J.with_uncertainty(feasible(feed), calibrated(feed))
    weekday = F.weekday(scoring_day(feed))
    seed = F.when(F.col("arm") == "baseline", 11).otherwise(12)
    project = lambda stacked, keys: J.project_positions(stacked, keys, H, 200, seed, weekday)
    return X.action_mix(cut_lineage(X.recommend(X.lever_values(ready, project, H))))


cte("today_donors", """
SELECT p.sku_uid, p.store_id AS donor_store, store_stock - coalesce(rate, usual) * 5 AS surplus, zone_norm AS z
FROM (SELECT * FROM panel WHERE date = (SELECT max(date) FROM panel)) p LEFT JOIN (SELECT store_id AS s, sku_uid AS k, max(trailing_demand_rate) AS rate FROM banded GROUP BY 1, 2) r ON r.s = p.store_id AND r.k = p.sku_uid
CROSS JOIN (SELECT median(trailing_demand_rate) AS usual FROM banded) JOIN store_dim s ON s.store_id = p.store_id WHERE store_stock - coalesce(rate, usual) * 5 >= 1
""")
cte("all_imbalances", """
SELECT b.store_id, b.sku_uid, donor_store, surplus, expected_lost_revenue FROM banded b JOIN store_dim s ON s.store_id = b.store_id JOIN today_donors d ON d.sku_uid = b.sku_uid AND d.z = s.zone_norm
WHERE risk_band IN ('Critical', 'High') AND donor_store <> b.store_id
""")
cte("imbalanced", """
SELECT * FROM all_imbalances ORDER BY expected_lost_revenue DESC, store_id, sku_uid, surplus DESC, donor_store LIMIT 40
""")


@query("imbalance", "store_id:s sku_uid:s donor_store:s surplus:f expected_lost_revenue:f4", "SELECT * FROM imbalanced")
def _imbalance(feed):
    scored = banded(feed)
    return X.imbalance(scored, donors_of(feed, scored, as_of(feed)), feed.store_dim)


ALERTS = " UNION ALL ".join(
    f"SELECT '{s}' AS severity, 'likely_out_{h}d' AS rule, count(*) AS positions, sum(expected_lost_revenue) AS metric FROM banded WHERE p_stockout_{h}d >= 0.5 HAVING count(*) > 0"
    for h, s in zip(P.HORIZONS, ("critical", "warning", "info")))


@query("alerts", "severity:s rule:s positions:i metric:f2", f"""
{ALERTS} UNION ALL SELECT 'critical', 'largest_exposure', 1, max(expected_lost_revenue) FROM banded
UNION ALL SELECT 'warning', 'inbound_shortfall', count(*), sum(expected_lost_revenue) FROM shelf_today
  WHERE risk_band IN ('Critical', 'High') AND trailing_demand_rate * 14 - stock_on_hand > 0 AND intransit_units < trailing_demand_rate * 14 - stock_on_hand HAVING count(*) > 0
UNION ALL (SELECT 'warning', 'late_vendor', 1, receipts FROM vendor_perf WHERE on_time_rate < 0.9 ORDER BY on_time_rate, vendor LIMIT 1)
UNION ALL SELECT 'warning', 'imbalance', count(*), sum(surplus) FROM all_imbalances HAVING count(*) > 0
UNION ALL SELECT 'info', 'lead_time_spread', n, s / m FROM (SELECT count(*) AS n, avg(lead_days) AS m, stddev_samp(lead_days) AS s FROM lead_times) WHERE s / m > 0.3
""")
def _alerts(feed):
    from shelfspan.operators.score import coverage_short
    feed = feed.settled()
    scored = cut_lineage(shelf(feed))
    vendors = R.supplier_performance(lead_columns(feed.goods_receipts))
    totals = X.imbalance_totals(scored, donors_of(feed, scored, as_of(feed)), feed.store_dim)
    return X.alerts(scored, coverage_short(scored), vendors, totals, R.lead_time_summary(leads(feed)))
