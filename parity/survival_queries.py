"""Product-limit curves, competing risks and the bias between two arms."""

from pyspark.sql import functions as F

from parity.base import cte, query
from shelfspan.operators import survival as V
from shelfspan.operators.spells import align_arms, build_spells
from parity.eventfeed import EventFeed


def km_ctes(name, source, event, by=""):
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    cte(f"{name}_exits", f"""
SELECT {keys}duration AS t, sum({event}) AS d, count(*) AS left_at FROM {source} GROUP BY {keys}duration
""")
    cte(f"{name}_risk", f"""
SELECT *, sum(left_at) OVER ({part}ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM {name}_exits
""")
    cte(name, f"""
SELECT *, CASE WHEN max(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER ({part}ORDER BY t) = 1 THEN 0.0
               ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER ({part}ORDER BY t)) END AS survival
FROM {name}_risk
""")


cte("tiered", "SELECT s.*, tier FROM spells s JOIN store_dim USING (store_id)")
km_ctes("km_all", "spells", "event")
km_ctes("km_tier", "tiered", "event", by="tier")


@query("km_curve", "t:i d:i n:i survival:f", "SELECT * FROM km_all")
def _km(feed):
    return V.kaplan_meier(feed.spells)


@query("km_median", "median:f", "SELECT min(t) AS median FROM km_all WHERE survival <= 0.5")
def _median(feed):
    return V.median_survival(V.kaplan_meier(feed.spells))


@query("km_by_stratum", "tier:s t:i d:i n:i survival:f", """
SELECT * FROM km_tier WHERE tier IN (SELECT tier FROM tiered GROUP BY tier HAVING count(*) >= 100)
""")
def _tiers(feed):
    tiered = feed.spells.join(feed.store_dim.select("store_id", F.col("TIER").alias("tier")), "store_id")
    large = tiered.groupBy("tier").agg(F.count("*").alias("k")).filter("k >= 100")
    return V.kaplan_meier(tiered, by=["tier"]).join(large, "tier", "left_semi")


@query("km_late_entry", "t:i d:i n:i survival:f", """
WITH e AS (SELECT *, CASE WHEN left_truncated AND duration > 1 THEN 1 ELSE 0 END AS entry FROM spells),
x AS (SELECT duration AS t, sum(event) AS d, count(*) AS left_at FROM e GROUP BY 1),
r AS (SELECT t, d, (SELECT count(*) FROM e WHERE e.duration >= x.t AND (e.entry = 0 OR e.entry < x.t)) AS n FROM x)
SELECT t, d, n, exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER (ORDER BY t))
       * CASE WHEN max(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER (ORDER BY t) = 1 THEN 0 ELSE 1 END AS survival FROM r
""")
def _late(feed):
    entered = feed.spells.withColumn("entry", F.when(F.col("left_truncated") & (F.col("duration") > 1), 1).otherwise(0))
    return V.kaplan_meier(entered, entry="entry")


cte("cif_exits", """
SELECT duration AS t, count(*) FILTER (WHERE end_reason = 'stockout') AS d1,
       count(*) FILTER (WHERE end_reason = 'replenished') AS d2, count(*) AS left_at FROM spells GROUP BY 1
""")
cte("cif_risk", "SELECT *, sum(left_at) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM cif_exits")
cte("cif_surv", """
SELECT *, CASE WHEN max(CASE WHEN d1 + d2 >= n THEN 1 ELSE 0 END) OVER (ORDER BY t) = 1 THEN 0.0
          ELSE exp(sum(CASE WHEN d1 + d2 < n THEN ln(1 - (d1 + d2) / n) ELSE 0 END) OVER (ORDER BY t)) END AS s FROM cif_risk
""")
cte("cif_curve", """
SELECT t, d1, d2, n, s, sum(s0 * d1 / n) OVER (ORDER BY t) AS c1, sum(s0 * d2 / n) OVER (ORDER BY t) AS c2
FROM (SELECT *, coalesce(lag(s) OVER (ORDER BY t), 1.0) AS s0 FROM cif_surv)
""")
cte("spell_days", "SELECT unnest(generate_series(0, max(duration))) AS t FROM spells")


@query("aj_cif", "t:i n:i d_stockout:i d_replenished:i cif_stockout:f cif_replenished:f",
       "SELECT t, n, d1 AS d_stockout, d2 AS d_replenished, c1 AS cif_stockout, c2 AS cif_replenished FROM cif_curve")
def _aj(feed):
    return V.cumulative_incidence(feed.spells)


@query("cif_partition", "t:i cif_stockout:f cif_replenished:f survival_any:f total:f", """
SELECT t, cif_stockout, cif_replenished, survival_any, cif_stockout + cif_replenished + survival_any AS total FROM (
SELECT s.t, coalesce(c1, 0) AS cif_stockout, coalesce(c2, 0) AS cif_replenished, coalesce(c.s, 1) AS survival_any
FROM spell_days s ASOF LEFT JOIN cif_curve c ON s.t >= c.t)
""")
def _partition(feed):
    return V.cif_partition(feed.spells)


@query("empirical_cif", "t:i cif:f", """
SELECT t, (SELECT avg(CASE WHEN end_reason = 'stockout' AND duration <= t THEN 1.0 ELSE 0.0 END) FROM spells) AS cif FROM spell_days
""")
def _ecif(feed):
    return V.empirical_cif(feed.spells)


cte("arm_a", """
SELECT * FROM spells s WHERE spell_id = 1 AND EXISTS (SELECT 1 FROM cf_spells c WHERE c.spell_id = 1 AND c.store_id = s.store_id AND c.sku_uid = s.sku_uid)
""")
cte("arm_b", """
SELECT * FROM cf_spells s WHERE spell_id = 1 AND EXISTS (SELECT 1 FROM spells c WHERE c.spell_id = 1 AND c.store_id = s.store_id AND c.sku_uid = s.sku_uid)
""")
km_ctes("km_a", "arm_a", "event")
km_ctes("km_b", "arm_b", "event")
cte("bias_days", """
SELECT unnest(generate_series(0, least((SELECT max(duration) FROM arm_a), (SELECT max(duration) FROM arm_b)))) AS t
""")
cte("bias_curve", """
SELECT x.t, naive, coalesce(b.survival, 1.0) AS truth FROM (
  SELECT d.t, coalesce(a.survival, 1.0) AS naive FROM bias_days d ASOF LEFT JOIN km_a a ON d.t >= a.t) x
ASOF LEFT JOIN km_b b ON x.t >= b.t
""")


def _arms(feed):
    other = EventFeed(feed.spark, feed.root, single_delivery=True)
    return align_arms(feed.spells, build_spells(other.ledger))


@query("km_bias_curve", "t:i naive:f truth:f difference:f",
       "SELECT t, naive, truth, naive - truth AS difference FROM bias_curve")
def _bias_curve(feed):
    return V.bias_curve(*_arms(feed))


@query(
    "km_bias",
    "median_naive:f median_true:f median_gap_days:f max_vertical_gap:f gap_at:f direction:s n_naive:i n_true:i censored_share:f",
    """
SELECT *, median_naive - median_true AS median_gap_days FROM (
SELECT (SELECT min(t) FROM km_a WHERE survival <= 0.5) AS median_naive, (SELECT min(t) FROM km_b WHERE survival <= 0.5) AS median_true,
       abs(naive - truth) AS max_vertical_gap, t AS gap_at, CASE WHEN naive - truth > 0 THEN 'optimistic' ELSE 'pessimistic' END AS direction,
       (SELECT count(*) FROM arm_a) AS n_naive, (SELECT count(*) FROM arm_b) AS n_true,
       (SELECT avg(CASE WHEN end_reason = 'replenished' THEN 1.0 ELSE 0.0 END) FROM arm_a) AS censored_share
FROM bias_curve ORDER BY abs(naive - truth) DESC, t LIMIT 1)
""")
def _bias(feed):
    return V.km_bias(*_arms(feed))


@query("shared_pairs", "store_id:s sku_uid:s", "SELECT store_id, sku_uid FROM arm_a")
def _shared(feed):
    other = EventFeed(feed.spark, feed.root, single_delivery=True)
    pair = ["store_id", "sku_uid"]
    first = feed.spells.filter("spell_id = 1").select(*pair)
    return first.intersect(build_spells(other.ledger).filter("spell_id = 1").select(*pair))
