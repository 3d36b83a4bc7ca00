"""As-of joins, lead times and the descriptive rollups."""

from pyspark.sql import functions as F

from parity.base import cte, query
from shelfspan.operators import rollups as R
from shelfspan.operators.asof import asof_join
from shelfspan.sources.extract import lead_columns, provenance

PAIR = ["store_id", "sku_uid"]


def as_of(feed):
    return feed.raw("events").agg(F.max("ts").cast("date").alias("d")).scalar()


@query("asof_inclusive", "store_id:s sku_uid:s date:d order_date:d", """
SELECT r.store_id, r.sku_uid, r.date, CASE WHEN date_diff('day', o.date, r.date) <= 3 THEN o.date END AS order_date
FROM (SELECT * FROM panel WHERE received > 0) r
ASOF LEFT JOIN (SELECT DISTINCT store_id, sku_uid, date FROM order_lines) o
  ON o.store_id = r.store_id AND o.sku_uid = r.sku_uid AND r.date >= o.date
""")
def _inclusive(feed):
    receipts = feed.ledger.filter("received > 0").select(*PAIR, "date")
    return asof_join(receipts, feed.replenishment_orders.withColumnRenamed("date", "order_date"), PAIR, "date", "order_date", tolerance_days=3, hot_keys=True)


cte("daily_rate", "SELECT store_id, date, sum(units_sold) AS sold FROM panel GROUP BY 1, 2")


@query("asof_strict", "store_id:s sku_uid:s spell_id:i spell_start:d date:d sold:f", """
SELECT s.store_id, s.sku_uid, s.spell_id, s.spell_start, d.date, d.sold FROM spells s
ASOF LEFT JOIN daily_rate d ON d.store_id = s.store_id AND s.spell_start > d.date
""")
def _strict(feed):
    daily = feed.ledger.groupBy("store_id", "date").agg(F.sum("units_sold").alias("sold"))
    left = feed.spells.select(*PAIR, "spell_id", "spell_start")
    return asof_join(left, daily, ["store_id"], "spell_start", "date", values=["sold"], strict=True, hot_keys=True)


cte("lead_times", """
SELECT r.store_id, r.sku_uid, date_diff('day', o.date, r.date) AS lead_days FROM (SELECT * FROM panel WHERE received > 0) r
ASOF JOIN (SELECT DISTINCT store_id, sku_uid, date FROM order_lines) o ON o.store_id = r.store_id AND o.sku_uid = r.sku_uid AND r.date >= o.date
WHERE date_diff('day', o.date, r.date) <= 30
""")


def leads(feed):
    return R.infer_lead_times(feed.ledger, feed.replenishment_orders)


@query("lead_times", "store_id:s sku_uid:s lead_days:i", "SELECT * FROM lead_times")
def _leads(feed):
    return leads(feed)


@query("lead_summary", "n:i mean:f std:f p95:f", """
SELECT count(*) AS n, avg(lead_days) AS mean, stddev_samp(lead_days) AS std, quantile_cont(lead_days, 0.95) AS p95 FROM lead_times
""")
def _lead_summary(feed):
    return R.lead_time_summary(leads(feed))


@query("lead_times_by_store", "store_id:s n:i mean:f std:f p90:f", """
SELECT store_id, count(*) AS n, avg(lead_days) AS mean, stddev_samp(lead_days) AS std, quantile_cont(lead_days, 0.9) AS p90 FROM lead_times GROUP BY 1
""")
def _lead_store(feed):
    return R.lead_times_by_store(leads(feed))


cte("observed_leads", "SELECT date_diff('day', order_date, date) AS lead_days FROM goods_receipts WHERE date >= order_date")


def observed(feed):
    return lead_columns(feed.goods_receipts).withColumn("lead_days", F.col("lead_days_actual")).filter("lead_days >= 0")


@query("lead_distribution", "n:i mean:f std:f p50:f p90:f", """
SELECT count(*) AS n, avg(lead_days) AS mean, stddev_samp(lead_days) AS std, median(lead_days) AS p50, quantile_cont(lead_days, 0.9) AS p90 FROM observed_leads
""")
def _distribution(feed):
    return R.lead_distribution(observed(feed))


@query("lead_histogram", "days:i receipts:i", "SELECT lead_days AS days, count(*) AS receipts FROM observed_leads GROUP BY 1")
def _histogram(feed):
    return R.lead_histogram(observed(feed))


cte("vendor_perf", """
SELECT vendor, count(*) AS receipts, avg(CASE WHEN date <= promised_date THEN 1.0 ELSE 0.0 END) AS on_time_rate,
       avg(date_diff('day', order_date, promised_date)) AS lead_days_promised, avg(date_diff('day', order_date, date)) AS lead_days_actual,
       stddev_samp(date_diff('day', order_date, date)) AS lead_days_std, quantile_cont(date_diff('day', promised_date, date), 0.9) AS days_late_p90, sum(qty) AS units
FROM goods_receipts GROUP BY 1
""")


@query("supplier_performance",
       "vendor:s receipts:i on_time_rate:f lead_days_promised:f lead_days_actual:f lead_days_std:f days_late_p90:f units:f", "SELECT * FROM vendor_perf")
def _suppliers(feed):
    return R.supplier_performance(lead_columns(feed.goods_receipts))


@query("forecast_weekly", "date:d forecast:f actual:f error:f", """
SELECT date, sum(forecast_units) AS forecast, sum(actual_units) AS actual, sum(forecast_units) - sum(actual_units) AS error FROM store_week GROUP BY 1
""")
def _weekly(feed):
    return R.forecast_weekly(feed.forecast_store_week)


@query("forecast_accuracy", "bias:f mape:f", """
SELECT sum(forecast_units) / sum(actual_units) AS bias, median(abs(forecast_units - actual_units) / actual_units) FILTER (WHERE actual_units > 0) AS mape FROM store_week
""")
def _accuracy(feed):
    return R.forecast_accuracy(feed.forecast_store_week)


@query("daily_trend", "date:d on_hand:f units_sold:f intransit_stock:f warehouse_stock:f", """
SELECT date, sum(s) AS on_hand, sum(u) AS units_sold, sum(t) AS intransit_stock, sum(w) AS warehouse_stock
FROM (SELECT date, sku_uid, sum(store_stock) AS s, sum(units_sold) AS u, sum(intransit_stock) AS t, min(warehouse_stock) AS w FROM inventory_daily GROUP BY 1, 2)
GROUP BY 1 ORDER BY date DESC LIMIT 14
""")
def _trend(feed):
    return R.last_days(R.daily_trend(full_panel(feed)), 14)


def full_panel(feed):
    stock = feed.inventory_daily.select(*PAIR, "date", "warehouse_stock", "intransit_stock")
    return feed.ledger.join(stock, [*PAIR, "date"])


cte("snapshot", """
SELECT *, CASE WHEN demand_rate > 0.01 THEN store_stock / demand_rate END AS days_of_supply, greatest(store_stock - demand_rate * 60, 0.0) AS excess_units
FROM (SELECT store_id, sku_uid, max(CASE WHEN date = d1 THEN store_stock END) AS store_stock, max(CASE WHEN date = d1 THEN warehouse_stock END) AS warehouse_stock,
             max(CASE WHEN date = d1 THEN intransit_stock END) AS intransit_stock, sum(units_sold) / 14 AS demand_rate
      FROM inventory_daily, stream_window WHERE date > d1 - 14 GROUP BY 1, 2)
""")


def snapshot(feed):
    return R.position_snapshot(full_panel(feed), as_of(feed), 14)


@query("position_snapshot", "store_id:s sku_uid:s store_stock:f warehouse_stock:f intransit_stock:f demand_rate:f days_of_supply:f excess_units:f",
       "SELECT * FROM snapshot")
def _snapshot(feed):
    return snapshot(feed)


@query("turnover", "turnover:f", """
SELECT sum(u) / count(*) * 365 / avg(s) AS turnover FROM (
SELECT date, sum(units_sold) AS u, sum(store_stock) AS s FROM panel, stream_window WHERE date > d1 - 21 GROUP BY 1)
""")
def _turnover(feed):
    return R.turnover(feed.ledger, as_of(feed), 21)


cte("totals", """
SELECT count(*) AS positions, sum(excess_units) AS excess_units, sum(store_stock) AS on_hand_units, sum(intransit_stock) AS intransit_units,
       median(days_of_supply) AS median_days_of_supply, (SELECT sum(w) FROM (SELECT min(warehouse_stock) AS w FROM snapshot GROUP BY sku_uid)) AS dc_units
FROM snapshot
""")


@query("network_totals", "positions:i excess_units:f on_hand_units:f intransit_units:f median_days_of_supply:f dc_units:f", "SELECT * FROM totals")
def _totals(feed):
    return R.network_totals(snapshot(feed))


@query("cover_histogram", "bucket:s positions:i", """
SELECT b.bucket, count(s.store_id) AS positions FROM (VALUES ('0-7', -1, 7), ('7-14', 7, 14), ('14-30', 14, 30), ('30-60', 30, 60), ('60+', 60, 1000000000)) b(bucket, lo, hi)
LEFT JOIN snapshot s ON s.days_of_supply > b.lo AND s.days_of_supply <= b.hi GROUP BY 1
""")
def _cover(feed):
    return R.cover_histogram(snapshot(feed))


@query("inventory_by_store", "store_id:s on_hand:f skus:i excess:f",
       "SELECT store_id, sum(store_stock) AS on_hand, count(*) AS skus, sum(excess_units) AS excess FROM snapshot GROUP BY 1")
def _by_store(feed):
    return R.inventory_by_store(snapshot(feed))


@query("open_orders", "open_orders:i", """
SELECT count(*) AS open_orders FROM order_lines, stream_window
WHERE date > d1 - CAST((SELECT ceil(avg(lead_days)) FROM lead_times) AS INTEGER) AND date <= d1
""")
def _open_orders(feed):
    mean = R.lead_time_summary(leads(feed)).select("mean").scalar()
    return R.open_orders(feed.replenishment_orders, as_of(feed), mean)


cte("line_sales", """
SELECT 'ST' || s_nationkey AS store_id, 'SKU' || (l_partkey % 50) AS sku_uid, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS units_sold
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3
""")


def line_sales(feed):
    """Quantities shipped per nation, SKU and day: they vary far more than counts of events do."""
    nation = feed.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return feed.raw("lineitem").join(nation, "l_suppkey").groupBy(
        F.concat(F.lit("ST"), "s_nationkey").alias("store_id"), F.concat(F.lit("SKU"), (F.col("l_partkey") % 50).cast("string")).alias("sku_uid"),
        F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("units_sold"))


@query("dispersion", "dispersion:f", """
SELECT coalesce(least(greatest(median(m * m / (v - m)), 0.1), 1e6), 1e6) AS dispersion FROM (
SELECT avg(units_sold) AS m, var_samp(units_sold) AS v, count(*) AS n FROM line_sales WHERE day(date) % 4 > 0 GROUP BY store_id, sku_uid)
WHERE n >= 5 AND m > 0 AND v > m
""")
def _dispersion(feed):
    sold = line_sales(feed)
    shelf = sold.select(*PAIR, "date", F.when(F.dayofmonth("date") % 4 > 0, 1.0).otherwise(0.0).alias("store_stock"))
    return R.demand_dispersion(sold, shelf, min_days=5)


@query("weekday_factors", "weekday:i factor:f", """
SELECT w AS weekday, least(greatest(m / (SELECT avg(units_sold) FROM panel WHERE units_sold > 0), 0.1), 5.0) AS factor
FROM (SELECT isodow(date) - 1 AS w, avg(units_sold) AS m FROM panel WHERE units_sold > 0 GROUP BY 1)
""")
def _weekday(feed):
    return R.weekday_factors(feed.ledger.filter("units_sold > 0")).select(F.posexplode("weekday_factor").alias("weekday", "factor"))


cte("part_sales", """
SELECT 'SKU' || l_partkey AS sku_uid, year(l_shipdate) AS year, month(l_shipdate) AS month, sum(l_quantity) AS sold FROM lineitem GROUP BY 1, 2, 3
""")
cte("part_plan", """
SELECT option_uid, size, year, month, sum(prediction_size) AS prediction_size FROM (
SELECT p_brand AS option_uid, CAST(p_size AS VARCHAR) AS size, y AS year, m AS month, CAST((p_partkey + m) % 9 * 5 AS DOUBLE) AS prediction_size
FROM part CROSS JOIN (SELECT unnest([1996, 1997]) AS y) CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m)) GROUP BY 1, 2, 3, 4
""")
cte("plan_ratio", """
SELECT ln(prediction_size / sold) AS ratio FROM part_sales JOIN product_dim USING (sku_uid)
JOIN part_plan USING (option_uid, size, year, month) WHERE sold > 0 AND prediction_size > 0
""")


def part_sales(feed):
    return feed.raw("lineitem").select(
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku_uid"), F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("units_sold"))


def part_plan(feed):
    months = feed.raw("part").select(
        F.col("p_brand").alias("option_uid"), F.col("p_size").cast("string").alias("size"), "p_partkey",
        F.explode(F.array(F.lit(1996), F.lit(1997))).alias("year")
    ).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return months.groupBy("option_uid", "size", "year", "month").agg(
        F.sum(((F.col("p_partkey") + F.col("month")) % 9 * 5).cast("double")).alias("prediction_size"))


@query("forecast_error", "n:i forecast_bias:f forecast_sigma:f", """
SELECT count(*) AS n, exp(median(ratio)) AS forecast_bias, stddev_samp(ratio) AS forecast_sigma FROM plan_ratio
""")
def _error(feed):
    return R.forecast_error(part_plan(feed), part_sales(feed), feed.product_dim)


@query("calibrate", "forecast_bias:f forecast_sigma:f dispersion:f lead_mean:f lead_sigma:f n_lead_observations:i monday:f", """
SELECT CASE WHEN n >= 2 THEN b ELSE 1.0 END AS forecast_bias, CASE WHEN n >= 2 THEN s ELSE 0.35 END AS forecast_sigma,
       greatest((SELECT coalesce(median(m * m / (v - m)), 1e6) FROM (SELECT avg(units_sold) AS m, var_samp(units_sold) AS v, count(*) AS n FROM panel WHERE store_stock > 0 AND units_sold > 0 GROUP BY store_id, sku_uid)
                 WHERE n >= 3 AND m > 0 AND v > m), 0.05) AS dispersion,
       (SELECT avg(lead_days) FROM lead_times) AS lead_mean, (SELECT stddev_samp(lead_days) FROM lead_times) AS lead_sigma,
       (SELECT count(*) FROM lead_times) AS n_lead_observations,
       (SELECT avg(units_sold) FILTER (WHERE isodow(date) = 1) / avg(units_sold) FROM panel WHERE units_sold > 0) AS monday
FROM (SELECT count(*) AS n, exp(median(ratio)) AS b, stddev_samp(ratio) AS s FROM (
  SELECT ln(prediction_size / sold) AS ratio FROM (SELECT sku_uid, year(date) AS year, month(date) AS month, sum(units_sold) AS sold FROM panel GROUP BY 1, 2, 3)
  JOIN product_dim USING (sku_uid) JOIN forecast_plan USING (option_uid, size, year, month) WHERE sold > 0 AND prediction_size > 0))
""")
def _calibrate(feed):
    sold = feed.ledger.filter("units_sold > 0")
    return R.calibrate(feed.ledger, sold, feed.replenishment_orders, feed.forecast, feed.product_dim, min_days=3, min_rows=2).withColumn(
        "monday", F.get("weekday_factor", F.lit(0)))


@query("provenance", "table:s present:i n_rows:i", """
SELECT 'orders' AS "table", true AS present, count(*) AS n_rows FROM orders UNION ALL SELECT 'part', true, count(*) FROM part
UNION ALL SELECT 'vendor_data', false, 0
""")
def _provenance(feed):
    return provenance({"orders": feed.raw("orders"), "part": feed.raw("part")}, ["vendor_data"], feed.spark)
