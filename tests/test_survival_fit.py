import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspan.functions import normal
from shelfspan.operators import evaluate as E
from shelfspan.operators import fit
from shelfspan.operators import ordering as O
from shelfspan.operators import survival as V
from shelfspan.operators.network import store_groups


def spells_of(spark, rows):
    return spark.createDataFrame(rows, "duration int, event int, end_reason string")


def test_textbook_curve(spark):
    got = {r.t: r.survival for r in V.kaplan_meier(spells_of(spark, [(d, 1, "stockout") for d in range(1, 6)])).collect()}
    assert [got[t] for t in (1, 2, 3)] == pytest.approx([0.8, 0.6, 0.4], abs=1e-12) and got[5] == 0.0


def test_parts_close(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), int(k == 0), ["stockout", "replenished", "window_end"][k]) for d, k in zip(rng.integers(1, 20, 300), rng.integers(0, 3, 300))]
    totals = [r.total for r in V.cif_partition(spells_of(spark, rows)).collect()]
    assert totals == pytest.approx([1.0] * len(totals), abs=1e-9)


@pytest.mark.parametrize("ranges", [1, 7, 16, 64])
def test_ranks_quantiles_and_pairs_against_brute_force(spark, ranges):
    rng = np.random.default_rng(ranges)
    values = np.concatenate([np.full(40, 2.5), np.round(rng.normal(size=80), 1), rng.normal(size=20)])
    times, events = rng.integers(1, 9, len(values)), rng.integers(0, 2, len(values))
    df = spark.createDataFrame([(float(v), int(t), int(e)) for v, t, e in zip(values, times, events)], "v double, t int, e int")
    q = O.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.93}, ranges=ranges).first()
    assert [q.a, q.b, q.c] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.93])), abs=1e-12)
    ranked = O.rank_all(df, {"r": ("v", True, "min"), "p": ("v", False, "pct")}, ranges=ranges).select("v", "r", "p").distinct().collect()
    for row in ranked:
        assert row.r == 1 + np.sum(values > row.v)
        assert row.p == pytest.approx((np.sum(values < row.v) + (np.sum(values == row.v) + 1) / 2) / len(values))
    coded = df.select((F.col("t") * 2 + 1 - F.col("e")).alias("code"), "v", (F.col("e") == 1).alias("s"), F.lit(1).alias("w"))
    got = O.ordered_pairs(coded, "code", "v", "s", "w", codes=20, ranges=ranges).first()
    code = times * 2 + 1 - events
    pairs = [(i, j) for i, j in itertools.permutations(range(len(values)), 2) if events[i] and code[i] < code[j]]
    assert got.pairs == len(pairs)
    assert got.concordant == sum(values[i] < values[j] for i, j in pairs)
    assert got.tied == sum(values[i] == values[j] for i, j in pairs)


def test_normal_matches_the_standard_library(spark):
    from statistics import NormalDist
    xs = [-9.0, -3.2, -0.5, 0.0, 0.7, 4.0, 8.5]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal.cdf(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-14)


@pytest.fixture(scope="module")
def survival_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 2))
    t = np.exp(1.5 + 0.6 * x[:, 0] - 0.3 * x[:, 1] + 0.5 * rng.normal(size=3000))
    c = rng.exponential(12.0, 3000)
    rows = [(float(a), float(b), float(max(min(s, k), 0.05)), int(s <= k)) for (a, b), s, k in zip(x, t, c)]
    return spark.createDataFrame(rows, "a double, b double, duration_model double, stockout_event int")


def test_aft_recovers_the_truth_and_ends_at_a_flat_point(survival_rows):
    model = fit.fit_aft(survival_rows, ["a", "b"], ridge=1e-6)
    assert model.coefficients == pytest.approx([0.6, -0.3], abs=0.05)
    assert model.intercept == pytest.approx(1.5, abs=0.05) and model.sigma == pytest.approx(0.5, abs=0.05)
    assert model.gradient_norm < 1e-6 and model.trace == sorted(model.trace)


def test_cox_signs_and_concordance(survival_rows):
    model = fit.fit_cox(survival_rows, ["a", "b"])
    assert model.coefficients[0] < 0 < model.coefficients[1] and model.gradient_norm < 1e-6
    assert E.concordance(survival_rows.withColumn("duration_model", F.ceil("duration_model").cast("double")), -model.partial_hazard()).first().c_index > 0.7


def test_pools_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for store in range(24):
        for sku in range(6):
            for day in range(1, 7):
                if rng.random() < 0.45:
                    value = 10 * (store % 3) + sku + day if sku else 0
                    rows.append((f"S{store:02d}", f"K{sku}", day, float(value)))
    df = spark.createDataFrame(rows, "store_id string, sku_uid string, d int, warehouse_stock double").selectExpr(
        "store_id", "sku_uid", "date_add(date'2024-01-01', d) as date", "warehouse_stock")
    seen = {}
    for s, k, d, v in rows:
        seen.setdefault(s, {})[(k, d)] = v
    label = {s: s for s in seen}
    for a, b in itertools.combinations(sorted(seen), 2):
        common = seen[a].keys() & seen[b].keys()
        if len(common) >= 5 and all(seen[a][c] == seen[b][c] for c in common):
            low, high = sorted((label[a], label[b]))
            label = {s: low if v == high else v for s, v in label.items()}
    assert {r.store_id: r.pool for r in store_groups(df).collect()} == label


def test_newton_keeps_its_point_when_no_step_gains():
    import numpy as np

    from shelfspan.operators.fit import _newton

    flat = lambda t: (-abs(float(t[0])) if t[0] else 0.0, np.array([1.0]), np.array([[-1.0]]))
    theta, value, _, _ = _newton(flat, np.zeros(1), np.zeros(1), 1, 5, 1e-10)
    assert theta[0] == 0 and value == 0


def test_newton_refuses_what_is_not_a_number():
    import numpy as np
    import pytest

    from shelfspan.operators.fit import _newton

    with pytest.raises(ValueError):
        _newton(lambda t: (float("nan"), np.array([1.0]), np.array([[-1.0]])), np.zeros(1), np.zeros(1), 1, 5, 1e-10)
    late = lambda t: (0.0 if t[0] == 0 else float("nan"), np.array([1.0]), np.array([[-1.0]]))
    assert _newton(late, np.zeros(1), np.zeros(1), 1, 5, 1e-10)[0][0] == 0
