"""The event feed as SQL, shared by the oracles."""

from parity.base import cte

cte("stream", "SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS date FROM events")
cte("stream_window", "SELECT min(date) AS d0, max(date) AS d1 FROM stream")
cte("day_list", "SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM stream_window")
cte("daily_flow", """
SELECT user_id, event_id % 2 * 51 + user_id % 51 AS part, date,
       4 * count(*) FILTER (WHERE event_type = 'signup') AS rcv,
       count(*) FILTER (WHERE event_type <> 'signup') AS dem
FROM stream GROUP BY 1, 2, 3
""")
cte("flow", """
SELECT u.user_id, u.part, d.date, coalesce(f.rcv, 0) AS rcv, coalesce(f.dem, 0) AS dem
FROM (SELECT DISTINCT user_id, which * 51 + user_id % 51 AS part FROM stream CROSS JOIN (VALUES (0), (1)) p(which)) u CROSS JOIN day_list d
LEFT JOIN daily_flow f ON f.user_id = u.user_id AND f.part = u.part AND f.date = d.date
""")


def walk_ctes(prefix: str, source: str) -> None:
    cte(f"{prefix}free", f"""
SELECT *, CAST(sum(rcv - dem) OVER (PARTITION BY user_id, part ORDER BY date) AS BIGINT) AS free FROM {source}
""")
    cte(f"{prefix}stocked", f"""
SELECT *, free - least(0, min(free) OVER (PARTITION BY user_id, part ORDER BY date)) AS stock FROM {prefix}free
""")
    cte(f"{prefix}opened", f"""
SELECT *, coalesce(lag(stock) OVER (PARTITION BY user_id, part ORDER BY date), 0) AS opened,
       coalesce(lead(rcv) OVER (PARTITION BY user_id, part ORDER BY date), 0) AS inbound
FROM {prefix}stocked
""")
    cte(f"{prefix}walk", f"""
SELECT 'ST' || user_id AS store_id, 'SKU' || part AS sku_uid, user_id, part, date, rcv, dem, stock, opened, inbound,
       least(dem, opened + rcv) AS sold, dem - least(dem, opened + rcv) AS lost
FROM {prefix}opened
""")
    cte(f"{prefix}panel", f"""
SELECT store_id, sku_uid, user_id, part, date, CAST(stock AS DOUBLE) AS store_stock, CAST(sold AS DOUBLE) AS units_sold,
       CAST(lost AS DOUBLE) AS lost_units, inbound, 
       CASE WHEN lag(stock) OVER w IS NULL THEN 0.0 ELSE greatest(CAST(stock - lag(stock) OVER w + sold AS DOUBLE), 0.0) END AS received
FROM {prefix}walk WINDOW w AS (PARTITION BY store_id, sku_uid ORDER BY date)
""")


walk_ctes("", "flow")
cte("cf_flow", """
SELECT user_id, part, date, CASE WHEN date = first_day THEN rcv ELSE 0 END AS rcv, dem
FROM (SELECT *, min(CASE WHEN rcv > 0 THEN date END) OVER (PARTITION BY user_id, part) AS first_day FROM flow)
""")
walk_ctes("cf_", "cf_flow")


def spell_ctes(name: str, panel: str, competing: bool) -> None:
    opens = "b IS NULL OR b <= 0" + (" OR received > 0" if competing else "")
    cte(f"{name}_marked", f"""
SELECT *, CASE WHEN store_stock > 0 AND ({opens}) THEN 1 ELSE 0 END AS opens
FROM (SELECT *, lag(store_stock) OVER (PARTITION BY store_id, sku_uid ORDER BY date) AS b FROM {panel})
""")
    cte(f"{name}_numbered", f"""
SELECT *, CAST(sum(opens) OVER (PARTITION BY store_id, sku_uid ORDER BY date) AS BIGINT) AS spell_id FROM {name}_marked
""")
    cte(f"{name}_seen", f"""
SELECT *, lead(date) OVER w AS next_date, lead(store_stock) OVER w AS next_stock, lead(spell_id) OVER w AS next_id,
       min(date) OVER (PARTITION BY store_id, sku_uid) AS pair_start
FROM {name}_numbered WINDOW w AS (PARTITION BY store_id, sku_uid ORDER BY date)
""")
    cte(f"{name}_runs", f"""
SELECT store_id, sku_uid, user_id, part, spell_id, min(date) AS spell_start, max(date) AS last_day,
       arg_min(store_stock, date) AS start_stock, sum(units_sold) AS units_sold_in_spell,
       max(next_date) AS next_date, last(next_stock ORDER BY date) AS next_stock, last(next_id ORDER BY date) AS next_id,
       bool_or(next_date IS NULL) AS at_end, min(pair_start) AS pair_start
FROM {name}_seen WHERE store_stock > 0 GROUP BY 1, 2, 3, 4, 5
""")
    cte(name, f"""
SELECT store_id, sku_uid, user_id, part, spell_id, spell_start, start_stock, units_sold_in_spell,
       CASE WHEN at_end THEN last_day ELSE next_date END AS spell_end,
       CASE WHEN at_end THEN date_diff('day', spell_start, last_day) + 1 ELSE date_diff('day', spell_start, next_date) END AS duration,
       CASE WHEN NOT at_end AND next_stock <= 0 THEN 1 ELSE 0 END AS event,
       CASE WHEN at_end THEN 'window_end' WHEN next_stock <= 0 THEN 'stockout' ELSE 'replenished' END AS end_reason,
       spell_start = pair_start AND spell_id = 1 AS left_truncated
FROM {name}_runs
""")


spell_ctes("spells", "panel", True)
spell_ctes("depleted", "panel", False)
spell_ctes("cf_spells", "cf_panel", True)

cte("store_dim", """
SELECT 'ST' || c_custkey AS store_id, n_name AS city_norm, r_name AS zone_norm, n_regionkey AS region_key,
       'Tier ' || (c_custkey % 4 + 1) AS tier, c_mktsegment AS segment, 'WH_' || r_name AS dc_id
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
cte("product_dim", """
SELECT 'SKU' || p_partkey AS sku_uid, p_brand AS option_uid, CAST(p_size AS VARCHAR) AS size, p_type AS category,
       p_retailprice AS price, p_partkey
FROM part
""")
cte("inventory_daily", """
SELECT p.store_id, sku_uid, date, store_stock,
       CAST(100 + 37 * region_key + 11 * part + 3 * day(date) AS DOUBLE) AS warehouse_stock,
       CAST(inbound AS DOUBLE) AS intransit_stock, units_sold, received
FROM panel p LEFT JOIN store_dim s ON s.store_id = p.store_id
""")
cte("order_lines", """
SELECT 'ST' || user_id AS store_id, 'SKU' || (event_id % 2 * 51 + user_id % 51) AS sku_uid,
       CAST(date - CAST(1 + event_id % 5 AS INTEGER) AS DATE) AS date, 4.0 AS qty
FROM stream WHERE event_type = 'signup'
""")
cte("goods_receipts", f"""
SELECT s_name AS vendor, l_quantity AS qty, CAST(l_shipdate AS DATE) AS date, CAST(o_orderdate AS DATE) AS order_date,
       CAST(CAST(o_orderdate AS DATE) + 45 AS DATE) AS promised_date
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
""")
cte("pending_orders", """
SELECT 'SKU' || l_partkey AS sku_uid, 'V' || l_suppkey AS vendor_id, l_quantity AS quantity
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
""")
cte("forecast_plan", """
SELECT p_brand AS option_uid, CAST(p_size AS VARCHAR) AS size, 2024 AS year, 1 AS month,
       CAST((p_partkey % 7 + 1) * 30 AS DOUBLE) AS prediction_size, p_retailprice AS avg_price,
       CAST(45 + p_partkey % 46 AS DOUBLE) AS lead_time
FROM part
""")
cte("promotions", """
SELECT n_name AS city_norm, date, CASE WHEN (day(date) + n_nationkey) % 7 = 0 THEN 1 ELSE 0 END AS promotion_flag,
       CASE WHEN (day(date) * 3 + n_nationkey) % 11 = 0 THEN 1 ELSE 0 END AS holiday_flag
FROM nation CROSS JOIN day_list
""")
cte("store_week", """
SELECT 'ST' || s_nationkey AS store_id, date, coalesce(lag(actual_units) OVER (PARTITION BY s_nationkey ORDER BY date), 0.0) AS forecast_units,
       actual_units
FROM (SELECT s_nationkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_quantity) AS actual_units
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
""")
