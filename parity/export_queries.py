"""Exports written and read back, quoted extracts, keys of a whole table, scoring at a chosen date."""

from datetime import timedelta

from pyspark.sql import functions as F

from parity.action_queries import H, PAIR, PATHS, draw_ctes, draws, past_cte, past_positions, recommended
from parity.base import cte, query
from parity.key_queries import key_texts, siz, txt
from parity.key_queries import col as colour_sql
from parity.quality_queries import findings
from parity.score_queries import demand_args, demand_policy_sql, shelf
from shelfspan.operators import panel as panel_ops
from shelfspan.operators import policy
from shelfspan.operators import project as J
from shelfspan.sources import sinks
from shelfspan.sources.extract import attach_keys, read_table


def shared_folder(feed, name):
    """A folder in the warehouse of this application's own."""
    return f"{feed.spark.conf.get('spark.sql.warehouse.dir')}/_{name}/{feed.spark.sparkContext.applicationId}"


@query("exports", "export:s store_id:s sku_uid:s label:s value:f2", f"""
SELECT 'risk' AS export, store_id, sku_uid, risk_band AS label, expected_lost_revenue AS value FROM shelf_today
UNION ALL SELECT 'prescriptions', store_id, sku_uid, recommended_action, expected_net_value FROM recs
UNION ALL SELECT 'policy', store_id, sku_uid, 'lead_time_demand 1', recommended_reorder_point FROM ({demand_policy_sql(0.95)})
UNION ALL SELECT 'validation', "table", "check", severity, n_bad FROM all_findings
""")
def _exports(feed):
    feed, folder = feed.settled(), shared_folder(feed, "exports")
    points = policy.reorder_from_demand(*demand_args(feed))
    made = {
        "risk": sinks.risk_list(shelf(feed)), "prescriptions": sinks.prescriptions(recommended(feed)),
        "policy": sinks.with_policy_provenance(points, "lead_time_demand", True, 0.95), "validation": findings(feed),
    }
    for name, frame in made.items():
        sinks.publish(frame, folder, name, {"tables": feed.root})
    back = {name: sinks.published(feed.spark, folder, name) for name in made}
    label = F.concat_ws(" ", "estimator", F.col("validated").cast("int"))
    rows = [
        back["risk"].select(F.lit("risk").alias("export"), *PAIR, F.col("risk_band").alias("label"), F.col("expected_lost_revenue").alias("value")),
        back["prescriptions"].select(F.lit("prescriptions"), *PAIR, "recommended_action", "expected_net_value"),
        back["policy"].select(F.lit("policy"), *PAIR, label, F.col("recommended_reorder_point").cast("double")),
        back["validation"].select(F.lit("validation"), "table", "check", "severity", F.col("n_bad").cast("double")),
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.union(part)
    return out


@query("quoted_extract", "id:i digest:s n_chars:i", r"""
SELECT doc_id AS id, sha256(coalesce(regexp_replace(text, '\r\n?', chr(10), 'g'), '')) AS digest, length(coalesce(regexp_replace(text, '\r\n?', chr(10), 'g'), '')) AS n_chars FROM documents
""")
def _quoted(feed):
    """Texts with quotes and line breaks, written as CSV and read back in ranges."""
    folder = shared_folder(feed, "quoted")
    texts = feed.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts.write.mode("overwrite").csv(folder, header=True, quoteAll=True, escape='"', escapeQuotes=True, lineSep="\n")
    back = read_table(feed.spark, folder, ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    return back.select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("digest"), F.char_length(text).alias("n_chars"))


@query("attach_keys", "p_partkey:i store_id:s store_id_repaired:i sku_uid:s option_uid:s zone_norm:s brand_norm:s", f"""
SELECT p_partkey, replace({txt('colour_text')}, ' ', '') AS store_id, false AS store_id_repaired,
       {txt('p_brand')} || '_' || p_size || '_' || {colour_sql('colour_text')} || '_' || {siz('size_text')} AS sku_uid,
       {txt('p_brand')} || '_' || p_size || '_' || {colour_sql('colour_text')} AS option_uid,
       trim(regexp_replace({txt("p_brand || ' Zone '")}, '\\s*ZONE\\s*$', '')) AS zone_norm, {txt('p_brand')} AS brand_norm
FROM key_texts
""")
def _attach(feed):
    texts = key_texts(feed).withColumns({"p_size": F.col("p_size").cast("string"), "ZONE ": F.concat("p_brand", F.lit(" Zone "))})
    spec = {"keys": {"store": "colour_text", "atoms": ("p_brand", "p_size", "colour_text", "size_text"), "zone": "ZONE ", "brand": "p_brand"}}
    return attach_keys(texts, spec, None)


cte("region_demand", "SELECT r_name, sum(l_quantity) AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")


@query("reorder_regions", "r_name:s demand:f reorder_point:i", """
SELECT r_name, min(d) AS demand, min(j) AS reorder_point FROM (
SELECT r_name, d, j, sum(exp(lgamma(j + 2.5) - lgamma(2.5) - lgamma(j + 1) + 2.5 * ln(2.5 / (2.5 + d)) + j * ln(d / (2.5 + d)))) OVER (PARTITION BY r_name ORDER BY j) AS cdf
FROM region_demand, (SELECT CAST(unnest(generate_series(0, (SELECT CAST(4 * max(d) AS BIGINT) FROM region_demand))) AS DOUBLE) AS j)) WHERE cdf >= 0.95 GROUP BY 1
""")
def _regions(feed):
    """Reorder points where demand is in the hundreds of thousands."""
    named = feed.raw("supplier").join(feed.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(feed.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    totals = feed.raw("lineitem").join(named.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name").agg(F.sum("l_quantity").alias("demand"))
    return totals.withColumn("reorder_point", policy.negative_binomial_quantile(F.col("demand"), F.lit(2.5), 0.95))


past_cte("chosen_rows", "SELECT min(date) + 12 AS a FROM panel")
draw_ctes("old", "chosen_rows", "", f"1 + (pid * 31 + path * 17) % {H + 1}", "0")


def chosen_day(feed):
    days = feed.raw("events").select(F.col("ts").cast("date").alias("date"))
    first = days.agg(F.min("date")).first()[0]
    return F.lit(panel_ops.backtest_date(days, H, first + timedelta(days=12)))


@query("backtest_at", "n_positions:i n_out:i p_stockout_mean:f brier:f", f"""
SELECT count(*) AS n_positions, count(actual) AS n_out, avg(mc_p_stockout) AS p_stockout_mean, avg((mc_p_stockout - CASE WHEN actual IS NULL THEN 0 ELSE 1 END) ** 2) AS brier FROM old_sum JOIN (
SELECT r.store_id, r.sku_uid, min(date_diff('day', a, p.date)) AS actual FROM chosen_rows r CROSS JOIN (SELECT min(date) + 12 AS a FROM panel)
LEFT JOIN panel p ON p.store_id = r.store_id AND p.sku_uid = r.sku_uid AND p.date > a AND p.date <= a + {H} AND p.store_stock <= 0 GROUP BY 1, 2) USING (store_id, sku_uid)
""")
def _backtest_at(feed):
    """Positions open at a chosen day, projected, against what came of them."""
    day = chosen_day(feed)
    positions = past_positions(feed, day)
    summary = J.summarise_paths(J.first_out_counts(J.paths_from_draws(draws(positions, PAIR, n_paths=PATHS), PAIR), PAIR, H), PAIR, H)
    both = summary.join(panel_ops.actual_outcomes(feed.ledger, positions.select(*PAIR), day, H), PAIR)
    out = F.col("actual_days_to_stockout").isNotNull().cast("int")
    return both.agg(F.count("*").alias("n_positions"), F.sum(out).alias("n_out"), F.avg("mc_p_stockout").alias("p_stockout_mean"),
                    F.avg(F.pow(F.col("mc_p_stockout") - out, 2)).alias("brier"))
