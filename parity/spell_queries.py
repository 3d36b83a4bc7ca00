"""Panel and spells."""

from pyspark.sql import functions as F

import parity.feed_sql  # noqa: F401
from parity.base import query
from shelfspan import params as P
from shelfspan.operators import panel as panel_ops
from shelfspan.operators import spells as S

PANEL = "store_id:s sku_uid:s date:d store_stock:f units_sold:f received:f ordered:f"
SPELL = (
    "store_id:s sku_uid:s spell_id:i spell_start:d spell_end:d duration:i event:i end_reason:s "
    "left_truncated:i start_stock:f units_sold_in_spell:f"
)


@query("panel_build", PANEL, """
SELECT p.store_id, p.sku_uid, p.date, store_stock, units_sold, received, coalesce(ordered, 0) AS ordered
FROM panel p LEFT JOIN (SELECT store_id, sku_uid, date, sum(qty) AS ordered FROM order_lines GROUP BY 1, 2, 3) o
  ON o.store_id = p.store_id AND o.sku_uid = p.sku_uid AND o.date = p.date
""")
def _panel(feed):
    return panel_ops.assemble_panel(feed.shelf, feed.sales_pos, feed.replenishment_orders)


@query("infer_receipts", "store_id:s sku_uid:s date:d received:f", """
SELECT store_id, sku_uid, date, received FROM panel WHERE received > 0
""")
def _receipts(feed):
    return panel_ops.assemble_panel(feed.shelf, feed.sales_pos).filter("received > 0")


@query("spells_competing", SPELL, "SELECT * FROM spells")
def _competing(feed):
    return S.build_spells(feed.ledger)


@query("spells_depletion", SPELL, "SELECT * FROM depleted")
def _depletion(feed):
    return S.build_spells(feed.ledger, mode="depletion")


@query(
    "spell_summary",
    "n_spells:i n_events:i event_rate:f median_duration:f left_truncated_rate:f informative_censor_rate:f",
    """
SELECT count(*) AS n_spells, sum(event) AS n_events, avg(event) AS event_rate, median(duration) AS median_duration,
       avg(CAST(left_truncated AS INTEGER)) AS left_truncated_rate,
       avg(CASE WHEN end_reason = 'replenished' THEN 1.0 ELSE 0.0 END) AS informative_censor_rate
FROM spells
""")
def _summary(feed):
    return S.summarise_spells(feed.spells)


@query("spell_end_reasons", "end_reason:s n_spells:i",
       "SELECT end_reason, count(*) AS n_spells FROM spells GROUP BY 1")
def _reasons(feed):
    return S.end_reason_counts(feed.spells)


@query("relabel_censoring", SPELL, """
SELECT * REPLACE (CASE WHEN end_reason = 'window_end' AND part = 1 THEN 'discontinued'
                       WHEN end_reason = 'window_end' AND user_id % 3 = 0 AND spell_end + 1 >= DATE '2024-01-30' THEN 'store_closed'
                       ELSE end_reason END AS end_reason)
FROM spells
""")
def _relabel(feed):
    stores = feed.raw("events").filter("user_id % 3 = 0").select(
        F.concat(F.lit("ST"), F.col("user_id").cast("string")).alias("store_id"),
        F.lit("2024-01-30").cast("date").alias("effective_date"))
    parts = feed.raw("part").filter("p_partkey = 1").select(
        F.lit("SKU1").alias("sku_uid"), F.lit("2024-01-01").cast("date").alias("effective_date"))
    gone = S.relabel_censoring(feed.spells, parts, "sku_uid", P.END_DISCONTINUED)
    return S.relabel_censoring(gone, stores, "store_id", P.END_STORE_CLOSED)


@query("first_spells", SPELL, "SELECT * FROM spells WHERE spell_id = 1")
def _first(feed):
    return S.first_spells(feed.spells)


@query("latest_position", SPELL, """
SELECT * FROM spells QUALIFY row_number() OVER (PARTITION BY store_id, sku_uid ORDER BY spell_start DESC) = 1
""")
def _latest(feed):
    return S.latest_position(feed.spells)


@query("open_positions", "store_id:s sku_uid:s spell_id:i as_of:d elapsed_days:i", """
SELECT store_id, sku_uid, spell_id, a AS as_of, greatest(date_diff('day', spell_start, a), 0) AS elapsed_days
FROM spells, (SELECT max(spell_end) AS a FROM spells) WHERE spell_start <= a AND spell_end >= a
""")
def _open(feed):
    return S.open_positions(feed.spells)


@query("panel_end", "panel_end:d as_of:d", "SELECT max(date) AS panel_end, max(date) - 14 AS as_of FROM panel")
def _panel_end(feed):
    return feed.ledger.agg(F.max("date").alias("panel_end")).withColumn("as_of", F.date_sub("panel_end", 14))


@query("actual_outcomes", "store_id:s sku_uid:s actual_days_to_stockout:f", """
WITH cut AS (SELECT max(date) - 14 AS a FROM panel)
SELECT q.store_id, q.sku_uid, date_diff('day', a, min(CASE WHEN store_stock <= 0 THEN date END)) AS actual_days_to_stockout
FROM panel q, cut WHERE date > a AND date <= a + 14 GROUP BY q.store_id, q.sku_uid, a
""")
def _outcomes(feed):
    as_of = panel_ops.latest_backtest_date(feed.ledger, 14).scalar()
    return panel_ops.actual_outcomes(feed.ledger, feed.ledger.select("store_id", "sku_uid").distinct(), as_of, 14)


@query("panel_value_at", "store_id:s sku_uid:s store_stock:f", """
SELECT s.store_id, s.sku_uid, p.store_stock FROM spells s
LEFT JOIN panel p ON p.store_id = s.store_id AND p.sku_uid = s.sku_uid AND p.date = DATE '2024-01-20'
WHERE s.spell_id = 1
""")
def _value_at(feed):
    first = S.first_spells(feed.spells).select("store_id", "sku_uid")
    return panel_ops.value_on(feed.ledger, first, F.lit("2024-01-20").cast("date"), "store_stock")


@query("panel_density", "store_id:s sku_uid:s observed:i expected:i dense:i", """
SELECT 'ST' || user_id AS store_id, 'SKU' || part AS sku_uid, count(*) AS observed,
       date_diff('day', min(date), max(date)) + 1 AS expected, count(*) = date_diff('day', min(date), max(date)) + 1 AS dense
FROM daily_flow GROUP BY 1, 2
""")
def _density(feed):
    days = feed.walk.filter("rcv + dem > 0")
    return panel_ops.density(days)
