"""Invariants, accounting checks, referential and density checks, DC recovery."""

from pyspark.sql import functions as F

from parity.base import cte, query
from shelfspan.operators import network as N
from shelfspan.operators import quality as Q

FINDING = "check:s table:s passed:i severity:s n_bad:i n_total:i bad_rate:f"


def finding_sql(check, table, severity, counts, passed="n_bad = 0", examples="''"):
    return f"""SELECT 'accounting.{check}' AS "check", '{table}' AS "table", {passed} AS passed, '{severity}' AS severity, n_bad, n_total,
       CASE WHEN n_total = 0 THEN 0.0 ELSE n_bad / n_total END AS bad_rate, coalesce({examples}, '') AS examples, '' AS detail FROM ({counts})"""


cte("stock_rows", """
SELECT i.*, warehouse_stock + store_stock + intransit_stock + CASE WHEN (day(date) + length(store_id)) % 9 = 0 THEN 1 ELSE 0 END AS opening_stk
FROM inventory_daily i
""")


def stock_rows(feed):
    broken = F.when((F.dayofmonth("date") + F.length("store_id")) % 9 == 0, 1.0).otherwise(0.0)
    return feed.inventory_daily.withColumn("opening_stk", F.col("opening_stk") + broken)


def register(name, table, frame, rule, counts, severity, passed="n_bad = 0"):
    sql = finding_sql(rule["name"], table, severity, counts, passed)

    @query(name, FINDING, sql)
    def _check(feed):
        return Q.table_invariants(frame(feed), table, [rule])


register("inv_sum_equals", "inventory_daily", stock_rows,
         {"name": "stock_components_sum_to_opening", "type": "sum_equals", "severity": "error",
          "parts": ["warehouse_stock", "store_stock", "intransit_stock"], "total": "opening_stk"},
         "SELECT count(*) FILTER (WHERE abs(warehouse_stock + store_stock + intransit_stock - opening_stk) > 0.5) AS n_bad, count(*) AS n_total FROM stock_rows",
         "error")

cte("engagement", """
SELECT user_id, date, count(*) FILTER (WHERE event_type = 'click') AS likes, count(*) FILTER (WHERE event_type = 'view') AS comments,
       count(*) FILTER (WHERE event_type = 'purchase') AS shares, count(*) FILTER (WHERE event_type <> 'error') AS reach,
       count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) AS engaged
FROM stream GROUP BY 1, 2
""")


def engagement(feed):
    kind = F.col("event_type")
    posts = feed.raw("events").groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(
        F.count_if(kind == "click").alias("likes"), F.count_if(kind == "view").alias("comments"),
        F.count_if(kind == "purchase").alias("shares"), F.count_if(kind != "error").alias("reach"))
    engaged = (F.col("likes") + F.col("comments") + F.col("shares")) / F.nullif(F.col("reach"), F.lit(0)) * 100
    return posts.withColumn("rate_pct", engaged + F.when(F.col("user_id") % 13 == 0, 1.0).otherwise(0.0))


register("inv_ratio_equals", "external_signals_fact", engagement,
         {"name": "engagement_rate_consistent", "type": "ratio_equals", "severity": "warn", "numerator": ["likes", "comments", "shares"],
          "denominator": "reach", "scale": 100, "result": "rate_pct", "tolerance": 0.05},
         "SELECT count(*) FILTER (WHERE reach > 0 AND user_id % 13 = 0) AS n_bad, count(*) FILTER (WHERE reach > 0) AS n_total FROM engagement",
         "warn")
register("inv_ratio_unverifiable", "external_signals_fact", lambda f: engagement(f).drop("reach"),
         {"name": "engagement_rate_consistent", "type": "ratio_equals", "numerator": ["likes"], "denominator": "reach", "result": "rate_pct"},
         "SELECT 0 AS n_bad, 0 AS n_total", "info", passed="true")
register("inv_non_negative", "customer", lambda f: f.raw("customer"),
         {"name": "non_negative_balance", "type": "non_negative", "columns": ["c_acctbal", "c_nationkey"], "severity": "error"},
         "SELECT count(*) FILTER (WHERE c_acctbal < 0) + count(*) FILTER (WHERE c_nationkey < 0) AS n_bad, 2 * count(*) AS n_total FROM customer", "error")
register("inv_positive", "customer", lambda f: f.raw("customer"),
         {"name": "positive_balance", "type": "positive", "columns": ["c_acctbal", "c_custkey"], "severity": "warn"},
         "SELECT count(*) FILTER (WHERE c_acctbal <= 0 OR c_acctbal IS NULL) + count(*) FILTER (WHERE c_custkey <= 0) AS n_bad, 2 * count(*) AS n_total FROM customer",
         "warn")
register("inv_not_constant", "orders", lambda f: f.raw("orders").withColumn("Warehouse_ID", F.lit("Warehouse")),
         {"name": "warehouse_id_is_identifying", "type": "not_constant", "columns": ["Warehouse_ID", "o_orderstatus"], "severity": "error"},
         "SELECT 1 AS n_bad, 2 AS n_total FROM (SELECT count(*) AS k FROM orders) WHERE k > 1", "error")
register("inv_constant_within_group", "inventory_daily", lambda f: f.inventory_daily,
         {"name": "warehouse_stock_not_store_scoped", "type": "constant_within_group", "group": ["sku_uid", "date"], "column": "warehouse_stock",
          "severity": "warn"},
         """SELECT coalesce(sum(k) FILTER (WHERE v > 1), 0) AS n_bad, sum(k) AS n_total FROM (SELECT count(*) AS k, count(DISTINCT warehouse_stock) AS v
            FROM inventory_daily GROUP BY sku_uid, date)""", "warn")
register("inv_date_order", "goods_receipts", lambda f: f.goods_receipts,
         {"name": "receipt_after_order", "type": "date_order", "earlier": "order_date", "later": "date", "severity": "error"},
         "SELECT count(*) FILTER (WHERE date < order_date) AS n_bad, count(*) AS n_total FROM goods_receipts", "error")

# stock goes missing now and then, so the movement checks have something to find
cte("leaky", """
SELECT * REPLACE (greatest(store_stock - CASE WHEN (user_id + day(date)) % 11 = 0 THEN 1 ELSE 0 END, 0.0) AS store_stock) FROM panel
""")
cte("moves", """
SELECT *, prev IS NOT NULL AND gap = 1 AS comparable, store_stock - prev + units_sold AS implied FROM (
SELECT store_id, sku_uid, date, store_stock, units_sold, lag(store_stock) OVER w AS prev, date_diff('day', lag(date) OVER w, date) AS gap
FROM leaky WINDOW w AS (PARTITION BY store_id, sku_uid ORDER BY date))
""")


def leaky(feed):
    day = F.col("user_id") + F.dayofmonth("date")
    stock = F.greatest(F.col("stock") - F.when(day % 11 == 0, 1).otherwise(0), F.lit(0)).cast("double")
    return feed.walk.select("store_id", "sku_uid", "date", stock.alias("store_stock"), F.col("sold").cast("double").alias("units_sold"))


MOVEMENT = finding_sql("stock_movement_sign", "inventory_daily", "error",
                       "SELECT count(*) FILTER (WHERE comparable AND implied < -0.5) AS n_bad, count(*) FILTER (WHERE comparable) AS n_total, max(-implied) FILTER (WHERE comparable AND implied < -0.5) AS worst FROM moves",
                       examples="'max ' || worst")
ATTRIBUTION = finding_sql("receipt_attribution", "inventory_daily", "warn", """
SELECT count(*) FILTER (WHERE NOT hit) AS n_bad, count(*) AS n_total FROM (
SELECT EXISTS (SELECT 1 FROM late_orders o WHERE o.store_id = m.store_id AND o.sku_uid = m.sku_uid AND o.date <= m.date AND o.date >= m.date - 3) AS hit
FROM moves m WHERE comparable AND implied > 0.5)""", "n_bad / n_total <= 0.2")
PHANTOM = finding_sql("phantom_stockout", "inventory_daily", "error", """
SELECT count(*) FILTER (WHERE NOT hit) AS n_bad, (SELECT count(*) FROM moves WHERE comparable) AS n_total, min(named) FILTER (WHERE NOT hit) AS first FROM (
SELECT store_id || '/' || sku_uid || '/' || CAST(date AS VARCHAR) AS named, EXISTS (SELECT 1 FROM late_orders o WHERE o.store_id = m.store_id AND o.sku_uid = m.sku_uid AND o.date <= m.date AND o.date >= m.date - 3) AS hit
FROM moves m WHERE comparable AND prev <= 0 AND units_sold > 0)""", examples="first")
cte("late_orders", "SELECT * FROM order_lines")


@query("stock_movement", FINDING, MOVEMENT)
def _movement(feed):
    return Q.stock_movement(leaky(feed))


@query("receipt_attribution", FINDING, ATTRIBUTION)
def _attribution(feed):
    return Q.receipt_attribution(leaky(feed), feed.replenishment_orders, lookback=3)


@query("phantom", FINDING, PHANTOM)
def _phantom(feed):
    return Q.phantom_stockout(leaky(feed), feed.replenishment_orders, lookback=3)


cte("all_findings", f"""
({finding_sql("stock_components_sum_to_opening", "inventory_daily", "error", "SELECT count(*) FILTER (WHERE off > 0.5) AS n_bad, count(*) AS n_total, max(off) FILTER (WHERE off > 0.5) AS worst FROM (SELECT abs(warehouse_stock + store_stock + intransit_stock - opening_stk) AS off FROM stock_rows)", examples="'diff=' || CAST(CAST(worst AS DOUBLE) AS VARCHAR)")})
UNION ALL ({finding_sql("non_negative_stock", "inventory_daily", "error", "SELECT count(*) FILTER (WHERE store_stock < 0) AS n_bad, 2 * count(*) AS n_total FROM stock_rows")})
UNION ALL ({finding_sql("receipt_after_order", "goods_receipts", "error", "SELECT count(*) FILTER (WHERE date < order_date) AS n_bad, count(*) AS n_total FROM goods_receipts")})
UNION ALL ({MOVEMENT}) UNION ALL ({ATTRIBUTION}) UNION ALL ({PHANTOM})
""")


def findings(feed):
    rules = [
        {"name": "stock_components_sum_to_opening", "type": "sum_equals", "severity": "error",
         "parts": ["warehouse_stock", "store_stock", "intransit_stock"], "total": "opening_stk"},
        {"name": "non_negative_stock", "type": "non_negative", "columns": ["store_stock", "warehouse_stock"], "severity": "error"},
    ]
    orders = feed.replenishment_orders
    ordered = [{"name": "receipt_after_order", "type": "date_order", "earlier": "order_date", "later": "date", "severity": "error"}]
    moved = leaky(feed)
    return Q.findings([
        Q.table_invariants(stock_rows(feed), "inventory_daily", rules), Q.table_invariants(feed.goods_receipts, "goods_receipts", ordered),
        Q.stock_movement(moved), Q.receipt_attribution(moved, orders, lookback=3), Q.phantom_stockout(moved, orders, lookback=3)])


@query("findings", FINDING + " examples:s detail:s", "SELECT * FROM all_findings")
def _findings(feed):
    return findings(feed)


@query("findings_filtered", FINDING + " examples:s detail:s", """SELECT * FROM all_findings WHERE severity = 'error' AND NOT passed AND "table" = 'inventory_daily'""")
def _filtered(feed):
    return Q.filter_findings(findings(feed), severity="error", passed=False, table="inventory_daily")


@query("finding_totals", "severity:s passed:s table:s n_checks:i n_failed:i n_blocking:i", """
SELECT severity, passed, "table", count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed, count(*) FILTER (WHERE NOT passed AND severity = 'error') AS n_blocking
FROM all_findings GROUP BY GROUPING SETS ((), (severity), (passed), ("table"), (severity, passed, "table"))
""")
def _totals(feed):
    return Q.finding_totals(findings(feed))


@query("unexplained_movement",
       "transitions:i unexplained_loss_events:i unexplained_loss_units:f unexplained_share_of_sales:f worst_single_loss:f", """
SELECT count(*) FILTER (WHERE comparable) AS transitions, count(*) FILTER (WHERE loss > 0) AS unexplained_loss_events, sum(loss) AS unexplained_loss_units,
       sum(loss) / sum(units_sold) AS unexplained_share_of_sales, max(loss) AS worst_single_loss
FROM (SELECT *, CASE WHEN comparable AND implied < -0.5 THEN -implied ELSE 0.0 END AS loss FROM moves)
""")
def _unexplained(feed):
    return Q.unexplained_movement(leaky(feed))


@query("grain_dups", "store_id:s sku_uid:s date:d n_rows:i", """
SELECT store_id, sku_uid, date, count(*) AS n_rows FROM order_lines GROUP BY 1, 2, 3 HAVING count(*) > 1
""")
def _dups(feed):
    return Q.duplicate_grain(feed.replenishment_orders, ["store_id", "sku_uid", "date"])


@query("common_window", "table:s first_day:d last_day:d", """
SELECT 'inventory_daily' AS "table", min(date) AS first_day, max(date) AS last_day FROM panel
UNION ALL SELECT 'sales_pos', min(date), max(date) FROM panel WHERE units_sold > 0
UNION ALL SELECT 'replenishment_orders', min(date), max(date) FROM order_lines
""")
def _window(feed):
    return Q.common_window({"inventory_daily": feed.shelf, "sales_pos": feed.sales_pos, "replenishment_orders": feed.replenishment_orders})


@query("ref_match_rate", "check:s n_total:i n_bad:i match_rate:f passed:i", """
SELECT 'lines_in_open_orders' AS "check", count(*) AS n_total, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_bad,
       count(o_orderkey) / count(*) AS match_rate, count(o_orderkey) / count(*) >= 0.99 AS passed
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey
""")
def _ref(feed):
    lines = feed.raw("lineitem").select(F.col("l_orderkey").alias("k"))
    parents = feed.raw("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return Q.reference_rate(lines, parents, "k", "lines_in_open_orders")


@query("ref_orphans", "l_orderkey:i l_linenumber:i", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def _orphans(feed):
    parents = feed.raw("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return Q.orphans(feed.raw("lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey")


@query("dc_varying_share", "sku_days:i varying_share:f", """
SELECT count(*) AS sku_days, avg(CASE WHEN v > 1 THEN 1.0 ELSE 0.0 END) AS varying_share
FROM (SELECT count(DISTINCT warehouse_stock) AS v FROM inventory_daily GROUP BY sku_uid, date)
""")
def _varying(feed):
    return N.varying_share(feed.inventory_daily)


# stores miss some days, so that signatures differ inside a pool
cte("dc_seen", "SELECT * FROM inventory_daily WHERE (length(store_id) + ascii(right(store_id, 1)) + day(date)) % 5 > 0")


@query("dc_groups", "store_id:s pool:s", """
SELECT i.store_id, min(i.store_id) OVER (PARTITION BY zone_norm, CAST(substr(i.store_id, 3) AS BIGINT) % 51) AS pool FROM (SELECT DISTINCT store_id FROM dc_seen) i JOIN store_dim s ON s.store_id = i.store_id
""")
def _groups(feed):
    seen = feed.inventory_daily.filter((F.length("store_id") + F.ascii(F.right("store_id", F.lit(1))) + F.dayofmonth("date")) % 5 > 0)
    return N.store_groups(seen)


# one store per zone reports what its neighbour zone does on some days, so its pool disagrees
cte("dc_torn", """
SELECT * REPLACE (CASE WHEN CAST(substr(store_id, 3) AS BIGINT) % 10 = 3 AND day(date) % 4 = 0 THEN warehouse_stock + 500 ELSE warehouse_stock END AS warehouse_stock) FROM inventory_daily
""")


@query("dc_groups_torn", "store_id:s pool:s", """
SELECT store_id, min(store_id) OVER (PARTITION BY zone_norm, CAST(substr(store_id, 3) AS BIGINT) % 51, odd) AS pool FROM (
SELECT DISTINCT i.store_id, s.zone_norm, CAST(substr(i.store_id, 3) AS BIGINT) % 10 = 3 AS odd FROM dc_torn i JOIN store_dim s ON s.store_id = i.store_id)
""")
def _torn(feed):
    odd = (F.substring("store_id", 3, 20).cast("bigint") % 10 == 3) & (F.dayofmonth("date") % 4 == 0)
    return N.store_groups(feed.inventory_daily.withColumn("warehouse_stock", F.col("warehouse_stock") + F.when(odd, 500.0).otherwise(0.0)))


@query("dc_verdict", "varying_share:f n_groups:i verdict:s", """
SELECT (SELECT avg(CASE WHEN v > 1 THEN 1.0 ELSE 0.0 END) FROM (SELECT count(DISTINCT warehouse_stock) AS v FROM inventory_daily GROUP BY sku_uid, date)) AS varying_share,
       (SELECT count(DISTINCT (zone_norm, CAST(substr(i.store_id, 3) AS BIGINT) % 51)) FROM inventory_daily i JOIN store_dim s ON s.store_id = i.store_id) AS n_groups, 'serving groups' AS verdict
""")
def _verdict(feed):
    return N.dc_verdict(feed.inventory_daily, N.store_groups(feed.inventory_daily))


@query("dc_mapping", "store_id:s dc_id:s mapped:i", """
SELECT store_id, CASE zone_norm WHEN 'AFRICA' THEN 'WH_SOUTH' WHEN 'AMERICA' THEN 'WH_WEST' WHEN 'ASIA' THEN 'WH_WEST' WHEN 'EUROPE' THEN 'WH_NORTH' ELSE 'WH_SOUTH' END AS dc_id,
       zone_norm IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') AS mapped FROM store_dim
""")
def _mapping(feed):
    dcs = feed.spark.createDataFrame(
        [(0, "WH_SOUTH", ["africa "]), (1, "WH_WEST", ["America", "ASIA"]), (2, "WH_NORTH", ["Europe"])],
        "position int, dc_id string, serves_zones array<string>")
    return N.dc_of_store(feed.store_dim.select("store_id", "zone_norm"), dcs, zone="zone_norm")


@query("ambiguous_zones", "zone:s n_dcs:i first_dc:s other_dc:s", """
SELECT r_name AS zone, count(*) AS n_dcs, min(dc_id) AS first_dc, max(dc_id) AS other_dc FROM (
SELECT DISTINCT r_name, 'WH_' || CAST(n_nationkey % 3 AS VARCHAR) AS dc_id FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1 HAVING count(*) > 1
""")
def _ambiguous(feed):
    """A configuration by the nations' numbers, where regions are split between warehouses."""
    served = feed.raw("nation").join(feed.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dcs = served.groupBy(F.concat(F.lit("WH_"), (F.col("n_nationkey") % 3).cast("string")).alias("dc_id")).agg(F.collect_set("r_name").alias("serves_zones"))
    return N.ambiguous_zones(dcs)
