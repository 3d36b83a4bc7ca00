"""One query per feature, then the modelling frame built from all of them.

The stream spans thirty days, so the windows are short here: 7, 3 and 5 rows, 10 days of
history, 7 days of promotions and 7 of burn-in.
"""

from pyspark.sql import functions as F

from parity.base import cte, query
from shelfspan.operators import modeling as M
from shelfspan.operators import spells as S
from shelfspan.operators.features import FEATURES, REGISTRY, Windows, build_features

WINDOWS = Windows(trailing=7, short=3, orders=5, history=10, promo=7)
BURN_IN = 7
PAIR = ["store_id", "sku_uid"]
NEEDS_ORDERS = {"open_order_qty"}
NEEDS_POOL = {"dc_stock_for_sku", "log_dc_stock"}


def feature_panel(feed, names):
    names = set(names)
    panel = feed.ledger_with_inbound
    if names & NEEDS_ORDERS:
        ordered = feed.replenishment_orders.groupBy(*PAIR, "date").agg(F.sum("qty").alias("ordered")).repartition(*PAIR)
        panel = panel.join(ordered, [*PAIR, "date"], "left")
    if names & NEEDS_POOL:
        region = feed.store_dim.select("store_id", "region_key")
        part = F.regexp_extract("sku_uid", r"(\d+)$", 1).cast("int")
        pool = (100 + 37 * F.col("region_key") + 11 * part + 3 * F.dayofmonth("date")).cast("double")
        panel = panel.join(region, "store_id", "left").withColumn("warehouse_stock", pool)
    return panel


def tables(feed, names):
    return {
        "panel": feature_panel(feed, names), "sales_pos": feed.sales_pos, "replenishment_orders": feed.replenishment_orders,
        "product_dim": feed.product_dim, "store_dim": feed.store_dim, "forecast": feed.forecast, "promotion_data": feed.promotion_data,
    }


def features_of(feed, names, spells=None):
    return build_features(feed.spells if spells is None else spells, tables(feed, names), WINDOWS, names)


cte("pf", """
SELECT p.store_id, p.sku_uid, p.date + 1 AS at_day, sum(units_sold) OVER w7 AS u7, sum(units_sold * units_sold) OVER w7 AS sq7,
       sum(CASE WHEN units_sold <= 0 THEN 1.0 ELSE 0.0 END) OVER w7 AS z7, count(*) OVER w7 AS n7, sum(units_sold) OVER w3 AS u3, count(*) OVER w3 AS n3,
       sum(coalesce(qty, 0)) OVER w5 AS o5, max(CASE WHEN received > 0 THEN p.date END) OVER wa AS last_receipt,
       CAST(inbound AS DOUBLE) AS intransit, CAST(100 + 37 * region_key + 11 * part + 3 * day(p.date) AS DOUBLE) AS pool
FROM panel p LEFT JOIN store_dim s ON s.store_id = p.store_id
LEFT JOIN (SELECT store_id, sku_uid, date, sum(qty) AS qty FROM order_lines GROUP BY 1, 2, 3) o ON o.store_id = p.store_id AND o.sku_uid = p.sku_uid AND o.date = p.date
WINDOW w7 AS (PARTITION BY p.store_id, p.sku_uid ORDER BY p.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w3 AS (PARTITION BY p.store_id, p.sku_uid ORDER BY p.date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       w5 AS (PARTITION BY p.store_id, p.sku_uid ORDER BY p.date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
       wa AS (PARTITION BY p.store_id, p.sku_uid ORDER BY p.date)
""")
cte("ext", """
SELECT sku_uid, abs(CASE WHEN k > 1 THEN (r - 1) / (k - 1) ELSE 0.5 END - 0.5) * 2 AS extremity FROM (
SELECT sku_uid, dense_rank() OVER (PARTITION BY option_uid ORDER BY CAST(size AS DOUBLE)) AS r, kk.k
FROM product_dim JOIN (SELECT option_uid, count(DISTINCT CAST(size AS DOUBLE)) AS k FROM product_dim GROUP BY 1) kk USING (option_uid))
""")
cte("runs_share", """
SELECT store_id, option_uid, date + 1 AS at_day, avg(CASE WHEN store_stock > 0 THEN 1.0 ELSE 0.0 END) AS run_share
FROM panel JOIN product_dim USING (sku_uid) GROUP BY 1, 2, 3
""")
cte("econ", "SELECT option_uid, median(avg_price) AS avg_price, median(lead_time) AS lead_time FROM forecast_plan GROUP BY 1")
cte("plan_month", "SELECT option_uid, size, year, month, sum(prediction_size) AS plan FROM forecast_plan GROUP BY 1, 2, 3, 4")
cte("cal", """
SELECT city_norm, date, sum(promotion_flag) OVER w AS p, sum(holiday_flag) OVER w AS h FROM promotions WINDOW w AS (PARTITION BY city_norm ORDER BY date)
""")
cte("cal_end", "SELECT city_norm, max(p) AS p, max(h) AS h FROM cal GROUP BY 1")
cte("hist", """
SELECT s.store_id, s.sku_uid, s.spell_id, count(q.spell_id) AS prior, count(q.spell_id) FILTER (WHERE q.event = 1) AS prior_out
FROM spells s LEFT JOIN spells q ON q.store_id = s.store_id AND q.sku_uid = s.sku_uid
 AND date_diff('day', q.spell_end, s.spell_start) > 0 AND date_diff('day', q.spell_end, s.spell_start) <= 10
GROUP BY 1, 2, 3
""")
cte("store_hist", """
SELECT s.store_id, s.spell_start, avg(CAST(q.event AS DOUBLE)) AS store_rate FROM (SELECT DISTINCT store_id, spell_start FROM spells) s
JOIN spells q ON q.store_id = s.store_id AND q.spell_end < s.spell_start GROUP BY 1, 2
""")
cte("fa", """
SELECT s.*, f.u7, f.sq7, f.z7, f.n7, f.u3, f.n3, f.o5, f.last_receipt, f.intransit, f.pool, f.u7 / f.n7 AS own_rate,
       d.option_uid, d.size AS size_label, d.category, sd.city_norm, sd.zone_norm, sd.tier, e.extremity, r.run_share, ec.avg_price AS price0, ec.lead_time AS lead0,
       pm.plan, prior, prior_out, store_rate, cs.p AS p0, cs.h AS h0, coalesce(ce.p, cl.p) AS p1, coalesce(ce.h, cl.h) AS h1
FROM spells s LEFT JOIN pf f ON f.store_id = s.store_id AND f.sku_uid = s.sku_uid AND f.at_day = s.spell_start
LEFT JOIN product_dim d ON d.sku_uid = s.sku_uid LEFT JOIN store_dim sd ON sd.store_id = s.store_id
LEFT JOIN ext e ON e.sku_uid = s.sku_uid LEFT JOIN runs_share r ON r.store_id = s.store_id AND r.option_uid = d.option_uid AND r.at_day = s.spell_start
LEFT JOIN econ ec ON ec.option_uid = d.option_uid
LEFT JOIN plan_month pm ON pm.option_uid = d.option_uid AND pm.size = d.size AND pm.year = year(s.spell_start) AND pm.month = month(s.spell_start)
LEFT JOIN hist h ON h.store_id = s.store_id AND h.sku_uid = s.sku_uid AND h.spell_id = s.spell_id
LEFT JOIN store_hist sh ON sh.store_id = s.store_id AND sh.spell_start = s.spell_start
LEFT JOIN cal cs ON cs.city_norm = sd.city_norm AND cs.date = s.spell_start LEFT JOIN cal ce ON ce.city_norm = sd.city_norm AND ce.date = s.spell_start + 7
LEFT JOIN cal_end cl ON cl.city_norm = sd.city_norm
""")
cte("fb", """
SELECT *, coalesce(own_rate, avg(own_rate) OVER (PARTITION BY store_id, coalesce(category, '')), avg(own_rate) OVER ()) AS rate,
       CASE WHEN last_receipt IS NOT NULL THEN greatest(date_diff('day', last_receipt, spell_start - 1), 0) END AS since0,
       coalesce(price0, median(price0) OVER ()) AS avg_price, coalesce(lead0, median(lead0) OVER ()) AS lead_time FROM fa
""")
cte("feat", """
SELECT *, rate AS trailing_demand_rate, CASE WHEN own_rate IS NULL THEN 1.0 ELSE 0.0 END AS demand_rate_imputed, ln(1 + greatest(rate, 0)) AS log_trailing_demand,
       CASE WHEN u3 IS NULL THEN 1.0 ELSE least(greatest(u3 / n3 / greatest(rate, 0.01), 0), 10) END AS demand_acceleration,
       CASE WHEN sq7 IS NULL THEN 0.0 ELSE least(sqrt(greatest(sq7 / n7 - greatest(rate, 1e-6) * greatest(rate, 1e-6), 0)) / greatest(rate, 1e-6), 20) END AS demand_cv,
       coalesce(z7 / n7, 0) AS intermittency, greatest(coalesce(p1 - p0, 0), 0) AS promo_days_ahead, greatest(coalesce(h1 - h0, 0), 0) AS holiday_days_ahead,
       cos(2 * pi() * (dayofyear(spell_start) - 295) / 365.25) AS seasonality_index, CASE WHEN isodow(spell_start) >= 5 THEN 1.0 ELSE 0.0 END AS starts_on_weekend,
       coalesce(plan, 0) AS forecast_units_month, least(greatest(coalesce(plan, 0) / 30.0 / greatest(rate, 0.01), 0), 20) AS forecast_vs_trailing,
       prior_out AS prior_stockouts_90d, CASE WHEN prior > 0 THEN prior_out / prior ELSE 0 END AS prior_stockout_rate, coalesce(store_rate, 0) AS store_stockout_rate_90d,
       ln(1 + greatest(start_stock, 0)) AS log_start_stock, start_stock / greatest(rate, 0.01) AS days_of_cover, ln(1 + start_stock / greatest(rate, 0.01)) AS log_days_of_cover,
       coalesce(intransit, 0) AS intransit_units, coalesce(pool, 0) AS dc_stock_for_sku, ln(1 + coalesce(pool, 0)) AS log_dc_stock, coalesce(o5, 0) AS open_order_qty,
       coalesce(since0, median(since0) OVER ()) AS days_since_last_receipt, coalesce(extremity, 0.5) AS size_extremity, coalesce(run_share, 1) AS size_run_completeness,
       ln(1 + avg_price) AS log_price, CASE tier WHEN 'Tier 1' THEN 1 WHEN 'Tier 2' THEN 2 WHEN 'Tier 3' THEN 3 ELSE 2 END AS tier_rank
FROM fb
""")

TEXT = {"option_uid", "size_label", "category", "zone_norm"}


def _register(name):
    kind = "s" if name in TEXT else "f"

    @query(f"feature_{name}", f"store_id:s sku_uid:s spell_id:i {name}:{kind}", f"SELECT store_id, sku_uid, spell_id, {name} FROM feat")
    def _feature(feed):
        return features_of(feed, [name])


for _name in REGISTRY:
    _register(_name)

MODEL_FEATURES = ["log_trailing_demand", "log_start_stock", "log_days_of_cover", "intermittency", "tier_rank", "promo_days_ahead"]


def modeled(feed, names=None):
    names = names or [*MODEL_FEATURES, "category", "zone_norm"]
    return M.modeling_frame(features_of(feed, names), BURN_IN)


cte("model_frame", """
SELECT *, CASE WHEN end_reason = 'stockout' THEN 1 ELSE 0 END AS stockout_event, CASE WHEN end_reason = 'replenished' THEN 1 ELSE 0 END AS censored_by_replenishment,
       greatest(duration, 0.5) AS duration_model FROM feat WHERE spell_start >= (SELECT min(spell_start) + 7 FROM feat)
""")


@query("modeling_frame",
       "store_id:s sku_uid:s spell_id:i duration_model:f stockout_event:i censored_by_replenishment:i " + " ".join(f"{n}:f" for n in FEATURES),
       "SELECT * FROM model_frame")
def _frame(feed):
    return modeled(feed, FEATURES)


def level_sql(column):
    return f"regexp_replace({column}, '\\W+', '_', 'g')"


@query("one_hot", "store_id:s sku_uid:s spell_id:i name:s value:f", " UNION ALL ".join(
    f"SELECT store_id, sku_uid, spell_id, '{prefix}_' || {level_sql(c)} AS name, 1.0 AS value FROM model_frame WHERE {level_sql(c)} > (SELECT min({level_sql(c)}) FROM model_frame)"
    for c, prefix in (("zone_norm", "zonecat"), ("category", "prodcat"))))
def _one_hot(feed):
    frame, levels = M.one_hot(modeled(feed, ["zone_norm", "category"]))
    held = frame.select(*PAIR, "spell_id", F.inline("hot"))
    return held.join(levels.select("place", "name"), "place")


@query("time_split", "store_id:s sku_uid:s spell_id:i part:s", """
SELECT store_id, sku_uid, spell_id, CASE WHEN epoch(spell_start) / 86400 < (SELECT quantile_cont(epoch(spell_start) / 86400, 0.7) FROM model_frame) THEN 'train' ELSE 'test' END AS part
FROM model_frame
""")
def _split(feed):
    return M.time_split(M.complete_cases(modeled(feed, ["log_start_stock"]), ["log_start_stock"]))


@query("model_input", "store_id:s sku_uid:s spell_id:i spell_start:d as_of:d elapsed_days:i " + " ".join(f"{n}:f" for n in MODEL_FEATURES), """
SELECT *, a AS as_of, greatest(date_diff('day', spell_start, a), 0) AS elapsed_days FROM model_frame, (SELECT max(spell_end) AS a FROM model_frame)
WHERE spell_start <= a AND spell_end >= a
""")
def _input(feed):
    return M.model_input(S.open_positions(modeled(feed, MODEL_FEATURES)), MODEL_FEATURES)
