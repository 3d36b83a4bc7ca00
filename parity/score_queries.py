"""Fits, evaluation, scoring, attribution and policy, under fixed parameters where SQL checks them."""

import numpy as np
from pyspark.sql import functions as F

from parity.base import cte, query
from parity.feature_queries import FEATURES, modeled
from parity.rollup_queries import as_of, leads
from parity.survival_queries import km_ctes
from shelfspan import params as P
from shelfspan.functions import normal
from shelfspan.operators import attribution as A
from shelfspan.operators import evaluate as E
from shelfspan.operators import fit, policy
from shelfspan.operators import modeling as M
from shelfspan.operators import rollups as R
from shelfspan.operators import score as C
from shelfspan.operators import spells as S
from shelfspan.session import cut_lineage

NAMES = ["log_days_of_cover", "intermittency", "tier_rank"]
MODEL = fit.AftModel(NAMES, [0.35, -0.4, 0.05], 1.2, 0.8)
OTHER = fit.AftModel(NAMES, [0.1, 0.3, -0.1], 1.9, 1.1)
WANTED = [*NAMES, "days_of_cover", "trailing_demand_rate", "avg_price", "intransit_units"]
PAIR = ["store_id", "sku_uid"]


def frame_of(feed, names=None):
    return cut_lineage(modeled(feed, names or NAMES))


def open_frame(feed, names=None):
    return cut_lineage(S.open_positions(modeled(feed, names or WANTED)))


def mu_sql(model):
    return f"{model.intercept} + " + " + ".join(f"({b}) * {n}" for n, b in zip(model.features, model.coefficients))


def cdf_sql(x):
    def horner(values):
        out = repr(values[0])
        for v in values[1:]:
            out = f"({out} * abs({x}) + {v!r})"
        return out
    w = f"exp(-abs({x}) * abs({x}) / 2)"
    f = f"(abs({x}) + 0.65)"
    for s in (4.0, 3.0, 2.0, 1.0):
        f = f"(abs({x}) + {s} / {f})"
    upper = (f"CASE WHEN abs({x}) > 37.0 THEN 0.0 WHEN abs({x}) < {normal.TAIL_FROM!r} THEN {w} * {horner(normal.NUMERATOR)} / {horner(normal.DENOMINATOR)} "
             f"ELSE {w} / {f} / {normal.ROOT_TWO_PI!r} END")
    return f"(CASE WHEN {x} > 0 THEN 1 - ({upper}) ELSE ({upper}) END)"


def survival_sql(t, mu, sigma):
    return f"(CASE WHEN {t} > 0 THEN {cdf_sql(f'(({mu} - ln({t})) / {sigma})')} ELSE 1.0 END)"


cte("mf", f"SELECT *, {mu_sql(MODEL)} AS mu, {mu_sql(OTHER)} AS mu2 FROM model_frame")
cte("mfp", f"SELECT *, exp(mu) AS median_days, 1 - {survival_sql('14.0', 'mu', MODEL.sigma)} AS p14, exp(mu2) AS median2, 1 - {survival_sql('14.0', 'mu2', OTHER.sigma)} AS q14 FROM mf")
cte("cx", f"SELECT duration_model, stockout_event, {MODEL.intercept} - mu AS eta FROM mf")
KEY = "store_id:s sku_uid:s spell_id:i "


@query("event_probability", KEY + "median_days:f p14:f", "SELECT * FROM mfp")
def _event(feed):
    return frame_of(feed).withColumns({"median_days": MODEL.median(), "p14": MODEL.event_probability(14)})


@query("aft_objective", "log_likelihood:f4", f"""
SELECT sum(CASE WHEN stockout_event = 1 THEN -z * z / 2 - ln(sqrt(2 * pi())) - ln({MODEL.sigma}) - ln(duration_model) ELSE ln({cdf_sql('(-z)')}) END) AS log_likelihood
FROM (SELECT *, (ln(duration_model) - mu) / {MODEL.sigma} AS z FROM mf)
""")
def _objective(feed):
    theta = np.array([MODEL.intercept, *MODEL.coefficients, np.log(MODEL.sigma)])
    frame = frame_of(feed)
    value, _, _ = fit.aft_sums(frame, NAMES, np.zeros(3), np.ones(3), theta)
    return frame.agg(F.lit(float(value)).alias("log_likelihood"))


@query("cox_objective", "log_likelihood:f4", f"""
SELECT sum(eta) - sum(ln(risk)) AS log_likelihood FROM (
SELECT m.eta, (SELECT sum(exp(o.eta)) FROM cx o WHERE o.duration_model >= m.duration_model) AS risk FROM cx m WHERE stockout_event = 1)
""")
def _cox_objective(feed):
    frame = frame_of(feed)
    value, _, _ = fit.cox_sums(frame, NAMES, -np.array(MODEL.coefficients))
    return frame.agg(F.lit(float(value)).alias("log_likelihood"))


cte("cx_risk", """
SELECT m.*, sum(exp(eta)) OVER later AS s0, sum(exp(eta) * days_of_cover) OVER later AS s1 FROM cx3 m
WINDOW later AS (ORDER BY duration_model DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
cte("cx3", f"SELECT duration_model, stockout_event, {MODEL.intercept} - mu AS eta, log_days_of_cover AS days_of_cover FROM mf")


@query("cox_slope", "slope:f4 curvature:f4", """
SELECT sum(days_of_cover - s1 / s0) AS slope, -sum(s2 / s0 - (s1 / s0) * (s1 / s0)) AS curvature FROM (
SELECT *, sum(exp(eta) * days_of_cover * days_of_cover) OVER (ORDER BY duration_model DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s2 FROM cx_risk) WHERE stockout_event = 1
""")
def _cox_slope(feed):
    """First and second derivative in the first coefficient, away from the optimum."""
    frame = frame_of(feed)
    _, slope, curvature = fit.cox_sums(frame, NAMES, -np.array(MODEL.coefficients))
    return frame.agg(F.lit(float(slope[0])).alias("slope"), F.lit(float(curvature[0, 0])).alias("curvature"))


def coefficients(spark_frame, model, extra):
    rows = [F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v in
            [*zip(model.features, model.coefficients), *extra]]
    return spark_frame.agg(F.count("*").alias("n_rows")).select("n_rows", F.inline(F.array(*rows)))


@query("aft_fit", "name:s value:f4 n_rows:i")
def _aft_fit(feed):
    frame = frame_of(feed)
    model = fit.fit_aft(frame, NAMES)
    return coefficients(frame, model, [("intercept", model.intercept), ("sigma", model.sigma), ("log_likelihood", model.log_likelihood)])


@query("cox_fit", "name:s value:f4 n_rows:i")
def _cox_fit(feed):
    frame = frame_of(feed)
    model = fit.fit_cox(frame, NAMES)
    return coefficients(frame, model, [("log_likelihood", model.log_likelihood)])


VARIED = " + ".join(f"CASE WHEN stddev_samp({n}) > 0 THEN 1 ELSE 0 END" for n in FEATURES)


@query("cox_flat", "n_rows:i n_events:i n_features:i n_varied:i flat:i gains:i", f"""
SELECT count(*) AS n_rows, sum(stockout_event) AS n_events, {len(FEATURES)} AS n_features, {VARIED} AS n_varied, 1 AS flat, 1 AS gains
FROM model_frame
""")
def _cox_flat(feed):
    """A fit over every numeric feature: its gradient is flat and it beats no features at all."""
    frame = frame_of(feed, FEATURES)
    model = fit.fit_cox(frame, FEATURES)
    nothing, _, _ = fit.cox_sums(frame, FEATURES, np.zeros(len(FEATURES)))
    return frame.agg(
        F.count("*").alias("n_rows"), F.sum("stockout_event").alias("n_events"), F.lit(len(model.coefficients)).alias("n_features"),
        F.lit(sum(c != 0 for c in model.coefficients)).alias("n_varied"), F.lit(model.gradient_norm < 1e-6).alias("flat"),
        F.lit(bool(model.log_likelihood > nothing)).alias("gains"))


@query("weibull_fit", "name:s value:f4 n_rows:i")
def _weibull(feed):
    frame = frame_of(feed)
    model = fit.weibull_aft(frame, NAMES)
    rows = [F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v in
            [*zip(NAMES, model.coefficients), ("intercept", model.intercept), ("scale", model.scale)]]
    return frame.agg(F.count("*").alias("n_rows")).select("n_rows", F.inline(F.array(*rows)))


def c_sql(score, where="true"):
    return f"""SELECT sum(1) AS pairs, sum(CASE WHEN a.{score} < b.{score} THEN 1 ELSE 0 END) AS concordant, sum(CASE WHEN a.{score} = b.{score} THEN 1 ELSE 0 END) AS tied
FROM (SELECT * FROM mfs WHERE stockout_event = 1 AND {where}) a JOIN (SELECT * FROM mfs WHERE {where}) b
ON b.duration_model > a.duration_model OR (b.duration_model = a.duration_model AND b.stockout_event = 0)"""


cte("mfs", """
SELECT *, round(median_days, 9) AS s1, round(median2, 9) AS s2,
       CASE WHEN epoch(spell_start) / 86400 < (SELECT quantile_cont(epoch(spell_start) / 86400, 0.7) FROM model_frame) THEN 'train' ELSE 'test' END AS fold FROM mfp
""")


class Rounded:
    """The fixed model with its score rounded, so both engines see the same ties."""

    def __init__(self, model):
        self.model = model

    def median(self):
        return F.round(self.model.median(), 9)

    def event_probability(self, h):
        return F.round(self.model.event_probability(h), 9)


@query("c_index", "pairs:i concordant:i tied:i c_index:f", f"SELECT *, (concordant + tied / 2) / pairs AS c_index FROM ({c_sql('s1')})")
def _c(feed):
    return E.concordance(frame_of(feed), Rounded(MODEL).median())


km_ctes("km_censor", "censor_rows", "ev")
cte("censor_rows", "SELECT duration_model AS duration, 1 - stockout_event AS ev FROM mfs")
km_ctes("km_censor_test", "censor_rows_test", "ev")
cte("censor_rows_test", "SELECT duration_model AS duration, 1 - stockout_event AS ev FROM mfs WHERE fold = 'test'")


def brier_sql(h, p, censor, where="true"):
    return f"""SELECT sum(w * (a - p) * (a - p)) / sum(w) AS brier FROM (
SELECT p, CASE WHEN f THEN 1.0 ELSE 0.0 END AS a, CASE WHEN f THEN 1 / greatest(survival, 0.001) WHEN duration_model > {h} THEN 1 / greatest(g, 0.001) ELSE 0 END AS w
FROM (SELECT duration_model, duration_model <= {h} AND stockout_event = 1 AS f, survival, {p} AS p, (SELECT min(survival) FROM {censor} WHERE t <= {h}) AS g
      FROM mfs JOIN {censor} ON t = duration_model WHERE {where}))"""


@query("brier", "brier:f", brier_sql(7, f"round(1 - {survival_sql('7.0', 'mu', MODEL.sigma)}, 9)", "km_censor"))
def _brier(feed):
    return E.brier(frame_of(feed), Rounded(MODEL).event_probability(7), 7)


cte("cal_edges", "SELECT list_sort(list_distinct(quantile_cont(round(p14, 9), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM mfs")
cte("cal_rows", """
SELECT duration_model AS duration, stockout_event AS ev, round(p14, 9) AS p, len(list_filter(e[2:len(e) - 1], lambda x: round(p14, 9) > x)) AS bin FROM mfs, cal_edges
""")
km_ctes("km_cal", "cal_rows", "ev", by="bin")


@query("calibration", "bin:i n:i predicted_mean:f observed_km:f gap:f", """
SELECT *, predicted_mean - observed_km AS gap FROM (SELECT bin, count(*) AS n, avg(p) AS predicted_mean,
 1 - coalesce((SELECT min(survival) FROM km_cal k WHERE k.bin = c.bin AND k.t <= 14), 1.0) AS observed_km FROM cal_rows c GROUP BY bin)
""")
def _calibration(feed):
    return E.calibration_table(frame_of(feed), Rounded(MODEL).event_probability(14), 14)


def compare_sql(label, score, mu, sigma):
    b = {h: brier_sql(h, f"round(1 - {survival_sql(f'{h}.0', mu, sigma)}, 9)", "km_censor_test", "fold = 'test'") for h in (7, 14)}
    c = {p: f"(SELECT (concordant + tied / 2) / pairs FROM ({c_sql(score, f'''fold = '{p}' ''')}))" for p in ("train", "test")}
    return f"""SELECT '{label}' AS model, count(*) FILTER (WHERE fold = 'train') AS n_train, count(*) FILTER (WHERE fold = 'test') AS n_test,
       sum(stockout_event) FILTER (WHERE fold = 'train') AS events_train, sum(stockout_event) FILTER (WHERE fold = 'test') AS events_test,
       {c['train']} AS c_index_train, {c['test']} AS c_index_test, ({b[7]}) AS brier_7d, ({b[14]}) AS brier_14d FROM mfs"""


@query("compare_models", "model:s n_train:i n_test:i events_train:i events_test:i c_index_train:f c_index_test:f brier_7d:f brier_14d:f",
       compare_sql("first", "s1", "mu", MODEL.sigma) + " UNION ALL " + compare_sql("second", "s2", "mu2", OTHER.sigma))
def _compare(feed):
    split = cut_lineage(M.time_split(frame_of(feed)))
    return E.compare_models(split.filter("part = 'train'"), split.filter("part = 'test'"), {"first": Rounded(MODEL), "second": Rounded(OTHER)})


# --- scoring ---------------------------------------------------------------
cte("open_rows", """
SELECT *, a AS as_of, greatest(date_diff('day', spell_start, a), 0) AS elapsed_days FROM mf, (SELECT max(spell_end) AS a FROM model_frame) WHERE spell_start <= a AND spell_end >= a
""")


def lost_sql(u):
    e = "CAST(elapsed_days AS DOUBLE)"
    return f"least(greatest(1 - {survival_sql(f'({e} + {u})', 'mu', MODEL.sigma)} / greatest({survival_sql(e, 'mu', MODEL.sigma)}, 1e-9), 0), 1)"


cte("risk_rows", f"SELECT *, {', '.join(f'{lost_sql(h)} AS p_stockout_{h}d' for h in P.HORIZONS)} FROM open_rows")
cte("days_out", f"""
SELECT store_id, sku_uid, spell_id, sum({lost_sql('u')}) AS expected_days_out FROM open_rows, (SELECT CAST(unnest(generate_series(1, 14)) AS DOUBLE) AS u) GROUP BY 1, 2, 3
""")
cte("ranked", """
SELECT *, rank() OVER (ORDER BY round(p_stockout_14d, 9) DESC) AS rank_by_risk, rank() OVER (ORDER BY round(expected_lost_units, 9) DESC) AS rank_by_units,
       rank() OVER (ORDER BY round(expected_lost_revenue, 6) DESC) AS rank_by_revenue FROM (
SELECT r.*, expected_days_out, expected_days_out * trailing_demand_rate AS expected_lost_units, expected_days_out * trailing_demand_rate * avg_price AS expected_lost_revenue
FROM risk_rows r JOIN days_out USING (store_id, sku_uid, spell_id))
""")
RISK = " ".join(f"p_stockout_{h}d:f" for h in P.HORIZONS)


@query("conditional_risk", KEY + "elapsed_days:i " + RISK, "SELECT * FROM risk_rows")
def _risk(feed):
    return C.conditional_risk(open_frame(feed, NAMES), MODEL)


@query("expected_days_out", KEY + "expected_days_out:f", "SELECT * FROM days_out")
def _days_out(feed):
    return C.expected_days_out(open_frame(feed, NAMES), MODEL, 14)


def ranked(feed):
    return C.rank_positions(open_frame(feed), MODEL)


@query("rank_positions", KEY + RISK + " expected_days_out:f expected_lost_units:f expected_lost_revenue:f4", "SELECT * FROM ranked")
def _rank(feed):
    return ranked(feed)


@query("rank_order", KEY + "rank_by_risk:i rank_by_units:i rank_by_revenue:i", "SELECT * FROM ranked")
def _rank_order(feed):
    scored = ranked(feed).drop("rank_by_risk", "rank_by_units", "rank_by_revenue")
    settled = scored.withColumns({"p_stockout_14d": F.round("p_stockout_14d", 9), "expected_lost_units": F.round("expected_lost_units", 9),
                                              "expected_lost_revenue": F.round("expected_lost_revenue", 6)})
    return C.rank_all(settled, {"rank_by_risk": ("p_stockout_14d", True, "min"), "rank_by_units": ("expected_lost_units", True, "min"),
                                "rank_by_revenue": ("expected_lost_revenue", True, "min")})


cte("banded", """
SELECT *, CASE WHEN p >= 0.6 AND v >= dear THEN 'Critical' WHEN p >= 0.6 OR (p >= 0.3 AND v >= dear) THEN 'High' WHEN p >= 0.3 OR v >= note THEN 'Medium' ELSE 'Low' END AS risk_band,
       round(100 * (0.6 * p + 0.4 * (r + (ties - 1) / 2) / n), 1) AS risk_score
FROM (SELECT *, p_stockout_14d AS p, expected_lost_revenue AS v, rank() OVER (ORDER BY expected_lost_revenue) AS r, count(*) OVER (PARTITION BY expected_lost_revenue) AS ties,
             count(*) OVER () AS n, quantile_cont(expected_lost_revenue, 0.8) OVER () AS dear, quantile_cont(expected_lost_revenue, 0.5) OVER () AS note
      FROM (SELECT * REPLACE (round(expected_lost_revenue, 4) AS expected_lost_revenue) FROM ranked))
""")


def banded(feed):
    scored = ranked(feed).withColumn("expected_lost_revenue", F.round("expected_lost_revenue", 4))
    return cut_lineage(C.attach_bands(scored))


@query("bands", KEY + "risk_band:s risk_score:f1", "SELECT * FROM banded")
def _bands(feed):
    return banded(feed)


@query("band_summary", "band:s positions:i lost_units:f1 lost_revenue:f0", """
SELECT b AS band, count(store_id) AS positions, coalesce(sum(expected_lost_units), 0) AS lost_units, coalesce(sum(expected_lost_revenue), 0) AS lost_revenue
FROM (SELECT unnest(['Critical', 'High', 'Medium', 'Low']) AS b) LEFT JOIN banded ON risk_band = b GROUP BY 1
""")
def _band_summary(feed):
    return C.band_summary(banded(feed))


cte("shelf_today", """
SELECT b.*, greatest(coalesce(p.store_stock, b.start_stock), 0) AS stock_on_hand, round(greatest(coalesce(p.store_stock, b.start_stock), 0) / greatest(trailing_demand_rate, 0.01), 2) AS cover_days_now
FROM banded b LEFT JOIN panel p ON p.store_id = b.store_id AND p.sku_uid = b.sku_uid AND p.date = b.as_of
""")


def shelf(feed):
    return C.with_shelf_today(banded(feed), feed.ledger, as_of(feed))


@query("shelf_today", KEY + "stock_on_hand:f cover_days_now:f", "SELECT * FROM shelf_today")
def _shelf(feed):
    return shelf(feed)


@query("position_filters", KEY, """
SELECT * FROM shelf_today WHERE risk_band IN ('High') AND p_stockout_14d >= 0.4 AND (contains(upper(sku_uid), 'KU1') OR contains(upper(store_id), 'KU1'))
""")
def _filters(feed):
    return C.filter_positions(shelf(feed), band="High", min_probability=0.4, search=" ku1 ")


@query("coverage_short", KEY, """
SELECT * FROM shelf_today WHERE trailing_demand_rate * 14 - stock_on_hand > 0 AND intransit_units < trailing_demand_rate * 14 - stock_on_hand
""")
def _short(feed):
    return C.filter_positions(shelf(feed), coverage="short")


@query("kpis", "positions_open:i skus_at_risk:i positions_7d:i positions_14d:i positions_28d:i revenue_7d:f2 revenue_14d:f2 revenue_28d:f2 inventory_value_at_risk:f2", """
SELECT count(*) AS positions_open, count(*) FILTER (WHERE risk_band IN ('Critical', 'High')) AS skus_at_risk,
""" + ", ".join(f"count(*) FILTER (WHERE p_stockout_{h}d >= 0.5) AS positions_{h}d, coalesce(sum(expected_lost_revenue) FILTER (WHERE p_stockout_{h}d >= 0.5), 0) AS revenue_{h}d" for h in P.HORIZONS) + """,
sum(expected_lost_revenue) AS inventory_value_at_risk FROM banded
""")
def _kpis(feed):
    return C.kpis(banded(feed))


@query("topology", "store_id:s dc_id:s positions:i at_risk:i exposure:f4 on_hand:f", """
SELECT r.store_id, s.dc_id, positions, at_risk, exposure, coalesce(on_hand, 0) AS on_hand
FROM (SELECT store_id, count(*) AS positions, count(*) FILTER (WHERE risk_band IN ('Critical', 'High')) AS at_risk, sum(expected_lost_revenue) AS exposure FROM banded GROUP BY 1) r
LEFT JOIN (SELECT store_id, sum(store_stock) AS on_hand FROM snapshot GROUP BY 1) k ON k.store_id = r.store_id LEFT JOIN store_dim s ON s.store_id = r.store_id
""")
def _topology(feed):
    snapshot = R.position_snapshot(feed.ledger, as_of(feed), 14)
    stores = feed.store_dim.select("store_id", "city_norm")
    return C.topology(banded(feed), snapshot, stores, feed.store_dim.select("store_id", "dc_id"))


@query("dc_nodes", "dc_id:s stores:i positions:i at_risk:i", """
SELECT s.dc_id, count(DISTINCT b.store_id) AS stores, count(*) AS positions, count(*) FILTER (WHERE risk_band IN ('Critical', 'High')) AS at_risk
FROM banded b JOIN store_dim s ON s.store_id = b.store_id GROUP BY 1
""")
def _dc_nodes(feed):
    snapshot = R.position_snapshot(feed.ledger, as_of(feed), 14)
    stores = feed.store_dim.select("store_id", "city_norm")
    return C.dc_nodes(C.topology(banded(feed), snapshot, stores, feed.store_dim.select("store_id", "dc_id")))


@query("paged_positions", KEY + "expected_lost_revenue:f4", """
SELECT * FROM banded ORDER BY expected_lost_revenue DESC, store_id, sku_uid, spell_id LIMIT 25 OFFSET 10
""")
def _page(feed):
    return C.page(banded(feed), "expected_lost_revenue", 10, 25)


@query("topn_per_store", KEY, """
SELECT * FROM banded QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY expected_lost_revenue DESC, sku_uid, spell_id) <= 1
""")
def _topn(feed):
    return C.largest_per_group(banded(feed), ["store_id"], "expected_lost_revenue", 1, ["sku_uid", "spell_id"])


@query("report", KEY.replace("spell_id:i ", "") + "days_of_cover:f2 p_stockout_14d:f4 expected_days_out:f2 expected_lost_units:f2", """
SELECT store_id, sku_uid, days_of_cover, p_stockout_14d, expected_days_out, expected_lost_units FROM ranked
""")
def _report(feed):
    return C.to_report(ranked(feed))


@query("depletion_timeline", "store_id:s sku_uid:s spell_id:i day:i projected_stock:f1", """
SELECT store_id, sku_uid, spell_id, day, greatest(stock_on_hand - trailing_demand_rate * day, 0) AS projected_stock FROM shelf_today, (SELECT unnest(generate_series(0, 28)) AS day)
""")
def _timeline(feed):
    return C.depletion_timeline(shelf(feed))


# --- attribution -----------------------------------------------------------
cte("ref_point", "SELECT " + ", ".join(f"avg({n}) AS r_{n}" for n in NAMES) + " FROM model_frame")
cte("parts", "SELECT o.*, " + ", ".join(f"({b}) * ({n} - r_{n}) AS c_{n}" for n, b in zip(NAMES, MODEL.coefficients)) +
    f", exp({MODEL.intercept} + " + " + ".join(f"({b}) * r_{n}" for n, b in zip(NAMES, MODEL.coefficients)) + ") AS ref_median FROM open_rows o, ref_point")
cte("day_parts", "SELECT *, " + ", ".join(f"CASE WHEN abs(total) > 1e-9 THEN c_{n} * (exp(mu) - ref_median) / total ELSE 0 END AS d_{n}" for n in NAMES) +
    " FROM (SELECT *, " + " + ".join(f"c_{n}" for n in NAMES) + " AS total FROM parts)")


def explained(feed):
    frame = frame_of(feed)
    return S.open_positions(frame), A.reference_point(frame, NAMES)


@query("contributions", KEY + " ".join(f"c_{n}:f" for n in NAMES), "SELECT * FROM parts")
def _parts(feed):
    return A.contributions(*_order(explained(feed)))


def _order(pair):
    return pair[0], MODEL, pair[1]


@query("contribution_days", KEY + " ".join(f"d_{n}:f" for n in NAMES), "SELECT * FROM day_parts")
def _day_parts(feed):
    return A.contribution_days(*_order(explained(feed)))


cte("drivers", """
SELECT *, list_sort(list_filter([{'effect': d_log_days_of_cover, 'name': 'log_days_of_cover'}, {'effect': d_intermittency, 'name': 'intermittency'}], lambda x: x.effect < 0)) AS worst FROM day_parts
""")


@query("explain", KEY + "predicted_median_days:f2 reference_median_days:f2 driver_1:s driver_1_effect:f2 driver_2:s driver_2_effect:f2", """
SELECT *, exp(mu) AS predicted_median_days, ref_median AS reference_median_days, coalesce(worst[1].name, '') AS driver_1, worst[1].effect AS driver_1_effect,
       coalesce(worst[2].name, '') AS driver_2, worst[2].effect AS driver_2_effect FROM drivers
""")
def _explain(feed):
    return A.explain(*_order(explained(feed)))


@query("top_drivers", KEY + "driver_1:s driver_1_effect:f", """
SELECT *, coalesce(w[1].name, '') AS driver_1, w[1].effect AS driver_1_effect FROM (SELECT *, list_sort(list_filter([{'effect': c_log_days_of_cover, 'name': 'log_days_of_cover'},
{'effect': c_intermittency, 'name': 'intermittency'}], lambda x: x.effect < 0)) AS w FROM parts)
""")
def _top(feed):
    raw = A.contributions(*_order(explained(feed)))
    return A.top_drivers(raw, {n: f"c_{n}" for n in NAMES})


@query("driver_summary", "feature:s times_top_driver:i coefficient:f share_of_rows:f4", f"""
SELECT feature, count(*) AS times_top_driver, CASE feature WHEN 'log_days_of_cover' THEN {MODEL.coefficients[0]} ELSE {MODEL.coefficients[1]} END AS coefficient,
       round(count(*) / (SELECT count(*) FROM parts), 4) AS share_of_rows
FROM (SELECT 'log_days_of_cover' AS feature FROM parts WHERE c_log_days_of_cover < 0 UNION ALL SELECT 'intermittency' FROM parts WHERE c_intermittency < 0) GROUP BY 1
""")
def _driver_summary(feed):
    return A.driver_summary(*_order(explained(feed)))


# --- policy ----------------------------------------------------------------
cte("latest_rows", "SELECT * FROM mf QUALIFY row_number() OVER (PARTITION BY store_id, sku_uid ORDER BY spell_start DESC) = 1")
MODEL_POLICY = f"""
SELECT *, ceil(cover * rate) AS recommended_reorder_point, ceil(rate * l + 1.645 * sqrt(rate * l)) AS textbook_reorder_point, round(rate * l, 2) AS expected_demand_over_lead,
       cover AS recommended_cover_days, l AS protection_days
FROM (SELECT * EXCLUDE (rate), greatest(trailing_demand_rate, 0.01) AS rate, least(greatest(exp(least((ln(l) - ({MODEL.sigma} * {normal.quantile(0.05)!r}) - (mu - {MODEL.coefficients[0]} * log_days_of_cover)) / {MODEL.coefficients[0]}, ln(401.0))) - 1, 0.1), 400.0) AS cover
      FROM latest_rows, (SELECT avg(lead_days) AS l FROM lead_times))
"""


def latest(feed):
    return S.latest_known(frame_of(feed, [*NAMES, "trailing_demand_rate", "days_of_cover"]), [*NAMES, "trailing_demand_rate", "days_of_cover"])


@query("reorder_model", "store_id:s sku_uid:s protection_days:f recommended_cover_days:f2 recommended_reorder_point:i textbook_reorder_point:i expected_demand_over_lead:f2", MODEL_POLICY)
def _reorder_model(feed):
    horizon = R.lead_time_summary(leads(feed)).select("mean").scalar()
    return policy.reorder_from_model(latest(feed), MODEL, horizon)


cte("lead_stats", "SELECT avg(lead_days) AS m, stddev_samp(lead_days) AS s FROM lead_times")
cte("demand_rows", "SELECT store_id, sku_uid, greatest(trailing_demand_rate, 0.001) AS rate, m + s AS days, greatest(trailing_demand_rate, 0.001) * (m + s) AS d FROM latest_rows, lead_stats")
cte("nb", """
SELECT store_id, sku_uid, j, sum(exp(lgamma(j + 2.5) - lgamma(2.5) - lgamma(j + 1) + 2.5 * ln(2.5 / (2.5 + d)) + j * ln(d / (2.5 + d)))) OVER (PARTITION BY store_id, sku_uid ORDER BY j) AS cdf
FROM demand_rows, (SELECT CAST(unnest(generate_series(0, 400)) AS DOUBLE) AS j)
""")


def demand_policy_sql(level):
    return f"""
SELECT r.store_id, r.sku_uid, days AS protection_days, {level} AS service_level, round(d, 2) AS expected_demand_over_lead, (SELECT min(j) FROM nb WHERE nb.store_id = r.store_id AND nb.sku_uid = r.sku_uid AND cdf >= {level}) AS recommended_reorder_point,
       ceil(d + 1.645 * sqrt(d)) AS textbook_reorder_point, rate FROM demand_rows r"""


def demand_args(feed):
    summary = R.lead_time_summary(leads(feed))
    return latest(feed), summary.select("mean").scalar(), summary.select("std").scalar(), F.lit(2.5)


@query("reorder_demand", "store_id:s sku_uid:s protection_days:f2 expected_demand_over_lead:f2 recommended_reorder_point:i textbook_reorder_point:i recommended_cover_days:f2 safety_stock:f2",
       f"SELECT *, recommended_reorder_point / rate AS recommended_cover_days, recommended_reorder_point - expected_demand_over_lead AS safety_stock FROM ({demand_policy_sql(0.95)})")
def _reorder_demand(feed):
    return policy.reorder_from_demand(*demand_args(feed))


@query("below_reorder", "store_id:s sku_uid:s stock_on_hand:f recommended_reorder_point:i", f"""
SELECT p.store_id, p.sku_uid, stock_on_hand, recommended_reorder_point FROM ({demand_policy_sql(0.95)}) p
JOIN (SELECT * FROM shelf_today QUALIFY row_number() OVER (PARTITION BY store_id, sku_uid ORDER BY spell_start DESC) = 1) s ON s.store_id = p.store_id AND s.sku_uid = p.sku_uid
WHERE stock_on_hand <= recommended_reorder_point
""")
def _below(feed):
    return policy.below_reorder_point(policy.reorder_from_demand(*demand_args(feed)), S.latest_position(shelf(feed))).filter("below_reorder_point")


@query("policy_frontier", "service_level:f positions:i total_points:i mean_point:f", " UNION ALL ".join(
    f"SELECT {q} AS service_level, count(*) AS positions, sum(recommended_reorder_point) AS total_points, avg(recommended_reorder_point) AS mean_point FROM ({demand_policy_sql(q)})"
    for q in (0.8, 0.95, 0.99)))
def _frontier(feed):
    frame, mean, std, k = demand_args(feed)
    return policy.policy_frontier(cut_lineage(frame), mean, std, k, [0.8, 0.95, 0.99])
