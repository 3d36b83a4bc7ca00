"""Arms, demand index, attention shares, plan allocation."""

from pyspark.sql import functions as F

from parity.base import cte, query
from shelfspan.operators import signals as G
from shelfspan.operators.spells import build_spells
from parity.eventfeed import EventFeed


def both_arms(feed):
    other = EventFeed(feed.spark, feed.root, single_delivery=True)
    named = lambda df, arm: df.withColumn("arm", F.lit(arm))
    panels = named(feed.ledger, "observed").unionByName(named(other.ledger, "single_delivery"))
    return panels, named(feed.spells, "observed").unionByName(named(build_spells(other.ledger), "single_delivery"))


def arm_sql(arm, panel, spells):
    return f"""SELECT '{arm}' AS arm, count(*) FILTER (WHERE store_stock <= 0) AS days_out_of_stock, avg(CASE WHEN store_stock <= 0 THEN 1.0 ELSE 0.0 END) AS days_out_of_stock_pct,
 sum(units_sold + lost_units) AS units_demanded, sum(units_sold) AS units_sold, sum(lost_units) AS units_lost, 1 - sum(lost_units) / sum(units_sold + lost_units) AS fill_rate,
 avg(store_stock) AS avg_store_stock, sum(store_stock) / count(DISTINCT date) AS avg_inventory_units, (SELECT count(*) FROM {spells}) AS spells,
 (SELECT sum(event) FROM {spells}) AS stockout_events, (SELECT avg(event) FROM {spells}) AS stockout_rate FROM {panel}"""


@query("arm_metrics", "arm:s days_out_of_stock:i days_out_of_stock_pct:f units_demanded:f units_sold:f units_lost:f fill_rate:f avg_store_stock:f avg_inventory_units:f spells:i stockout_events:i stockout_rate:f",
       arm_sql("observed", "panel", "spells") + " UNION ALL " + arm_sql("single_delivery", "cf_panel", "cf_spells"))
def _arms(feed):
    return G.arm_metrics(*both_arms(feed))


GROUP = ["city_norm", "sku_uid"]
cte("city_week", """
SELECT city_norm, sku_uid, CAST(date_trunc('week', date) AS DATE) AS week, sum(units_sold + lost_units) AS latent_units, sum(lost_units) AS lost_units
FROM panel JOIN store_dim USING (store_id) GROUP BY 1, 2, 3
""")
cte("demand_idx", "SELECT *, latent_units / greatest(avg(latent_units) OVER (PARTITION BY city_norm, sku_uid), 1e-6) AS demand_index FROM city_week")
cte("buzz", """
SELECT *, least(greatest(coalesce(lead(demand_index) OVER w, demand_index), 0.05), 12.0) AS buzz_index, lead(demand_index) OVER w AS next_demand
FROM demand_idx WINDOW w AS (PARTITION BY city_norm, sku_uid ORDER BY week)
""")
cte("trend", """
SELECT *, coalesce((buzz_index - before) / greatest(before, 1e-6), 0) AS buzz_wow FROM (SELECT *, lag(buzz_index) OVER (PARTITION BY city_norm, sku_uid ORDER BY week) AS before FROM buzz)
""")


def index_of(feed):
    cities = feed.store_dim.select("store_id", "city_norm")
    return G.demand_index(feed.ledger.join(cities, "store_id"), GROUP)


@query("demand_index", "city_norm:s sku_uid:s week:d latent_units:f lost_units:f demand_index:f", "SELECT * FROM demand_idx")
def _index(feed):
    return index_of(feed)


@query("trend_label", "city_norm:s sku_uid:s week:d buzz_index:f buzz_wow:f trend_signal:s", """
SELECT *, CASE WHEN buzz_wow > 0.1 THEN 'Trending Up' WHEN buzz_wow < -0.1 THEN 'Trending Down' ELSE 'Stable' END AS trend_signal FROM trend
""")
def _trend(feed):
    return G.leading_index(index_of(feed), GROUP)


@query("complaint_pressure", "city_norm:s sku_uid:s week:d complaint_pressure:f", """
SELECT city_norm, sku_uid, week, least(greatest(lost_units / greatest(max(lost_units) OVER (PARTITION BY city_norm), 1.0), 0), 1) AS complaint_pressure FROM demand_idx
""")
def _pressure(feed):
    return G.complaint_pressure(index_of(feed))


RHO = """SELECT count(*) AS n, corr(l, r) AS rho, '{name}' AS against FROM (
SELECT rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS l, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS r
FROM (SELECT round(buzz_index, 9) AS b, round({other}, 9) AS d FROM buzz WHERE {other} IS NOT NULL))"""


@query("lead_corr", "n:i rho:f against:s", RHO.format(name="next_week", other="next_demand") + " UNION ALL " + RHO.format(name="this_week", other="demand_index"))
def _corr(feed):
    ahead = G.leading_index(index_of(feed).withColumn("demand_index", F.round("demand_index", 9)), GROUP)
    return G.lead_check(ahead, GROUP)


OWN, OTHERS = ["click", "view"], ["purchase", "error"]


@query("brand_groups", "city_norm:s sku_uid:s week:d brand:s brand_is_own:i", """
SELECT city_norm, sku_uid, week, brand, brand IN ('click', 'view') AS brand_is_own FROM demand_idx, (SELECT unnest(['click', 'view', 'purchase', 'error']) AS brand)
""")
def _brands(feed):
    return G.brand_groups(index_of(feed), OWN, OTHERS)


@query("share_of_voice", "city_norm:s week:d brand:s mentions:i share_of_voice_pct:f2", """
SELECT *, round(mentions / sum(mentions) OVER (PARTITION BY city_norm, week) * 100, 2) AS share_of_voice_pct FROM (
SELECT city_norm, CAST(date_trunc('week', date) AS DATE) AS week, event_type AS brand, count(*) AS mentions FROM stream JOIN store_dim ON store_id = 'ST' || user_id GROUP BY 1, 2, 3)
""")
def _voice(feed):
    from parity.eventfeed import store_key
    events = feed.raw("events").select(store_key(F.col("user_id")).alias("store_id"), F.col("event_type").alias("brand"), F.col("ts").cast("date").alias("date"))
    mentions = events.join(feed.store_dim.select("store_id", "city_norm"), "store_id").groupBy("city_norm", G.week_of("date").alias("week"), "brand").agg(
        F.count("*").alias("mentions"))
    return G.share_of_voice(mentions, ["city_norm", "week"])


@query("store_week_alloc", "store_id:s sku_uid:s week:d actual_units:f store_share:f forecast_units:f2", """
WITH w AS (SELECT store_id, sku_uid, CAST(date_trunc('week', date) AS DATE) AS week, sum(units_sold) AS actual_units FROM panel GROUP BY 1, 2, 3),
s AS (SELECT store_id, sku_uid, sum(actual_units) / greatest(sum(sum(actual_units)) OVER (PARTITION BY sku_uid), 1) AS store_share FROM w GROUP BY 1, 2),
c AS (SELECT sku_uid, week, sum(actual_units) AS plan_units FROM w GROUP BY 1, 2)
SELECT *, round(CAST(plan_units * store_share AS DECIMAL(18, 9)), 2) AS forecast_units FROM w JOIN s USING (store_id, sku_uid) JOIN c USING (sku_uid, week)
""")
def _alloc(feed):
    return G.store_week_plan(feed.ledger)
