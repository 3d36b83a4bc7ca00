"""The forms that carry hot keys, whole-table order and large demand, against plain versions."""

import bisect
import csv
import itertools
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspan import params as P
from shelfspan.operators import fit, network, policy
from shelfspan.operators import panel as panel_ops
from shelfspan.operators import prescribe as X
from shelfspan.operators import quality as Q
from shelfspan.operators.asof import asof_join
from shelfspan.operators.ordering import place, rank_all
from shelfspan.operators.selection import decoded, exact_quantiles, ordered_code
from shelfspan.sources import sinks
from shelfspan.sources.extract import read_table

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
       float("inf"), float("-inf"), 0.1, 1 / 3, 1024.0, math.nextafter(1024.0, 0), math.nextafter(1024.0, 2000), 1e22, 123456.789]


def test_codes_order_as_numbers_and_come_back(spark):
    rows = spark.createDataFrame([(v,) for v in ODD + [float("nan"), None]], "v double").select("v", ordered_code(F.col("v")).alias("c")).collect()
    known = [(r.v, r.c) for r in rows if r.v is not None]
    for (a, x), (b, y) in itertools.product([k for k in known if k[0] == k[0]], repeat=2):
        assert (a < b) == (x < y) and (a == b) == (x == y)
    assert all(decoded(c) == v for v, c in known if v == v)
    assert max(c for v, c in known) == next(c for v, c in known if v != v)
    assert [r.c for r in rows if r.v is None] == [None]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_of_several_columns_at_once(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=301) * 10.0 ** rng.integers(-8, 9, 301), np.where(rng.random(301) < 0.6, 7.25, rng.integers(0, 40, 301))
    rows = [(float(x), None if k % 5 == 0 else float(y), None) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_quantiles(df, {"a50": (F.col("a"), 0.5), "a13": (F.col("a"), 0.13), "b50": (F.col("b"), 0.5), "b99": (F.col("b"), 0.99), "c": (F.col("c"), 0.5), "a0": (F.col("a"), 0.0), "a1": (F.col("a"), 1.0)})
    kept = [y for x, y, _ in rows if y is not None]
    assert [got["a50"], got["a13"], got["a0"], got["a1"]] == pytest.approx(list(np.quantile(a, [0.5, 0.13, 0, 1])), rel=1e-12)
    assert [got["b50"], got["b99"]] == pytest.approx(list(np.quantile(kept, [0.5, 0.99]))) and got["c"] is None
    assert exact_quantiles(df.limit(0), {"a": (F.col("a"), 0.5)}) == {"a": None}


@pytest.mark.parametrize("ranges", [None, 3, 40])
def test_ranks_of_rows_with_a_hot_value(spark, ranges):
    rng = np.random.default_rng(4)
    v = [2.5] * 70 + [round(float(x), 1) for x in rng.normal(size=50)] + [None] * 5 + [float("inf"), -0.0, 0.0]
    w = [float(x) for x in rng.integers(0, 4, len(v))]
    df = spark.createDataFrame(list(zip(range(len(v)), v, w, ["x"] * len(v))), "id long, v double, w double, _range string")
    df = df.withColumnRenamed("_range", "note")
    got = rank_all(df, {"r": ("v", True, "min"), "p": ("v", False, "pct"), "m": ("w", False, "average")}, ranges=ranges)
    assert got.columns == ["id", "v", "w", "note", "r", "p", "m"]
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(len(v)))
    known = sorted(x for x in v if x is not None)
    for r in rows:
        below, same = bisect.bisect_left(sorted(w), r.w), w.count(r.w)
        assert r.m == below + (same + 1) / 2
        if r.v is None:
            assert r.r is None and r.p is None
            continue
        below, same = sum(x < r.v for x in known), sum(x == r.v for x in known)
        assert r.r == len(known) - below - same + 1 and r.p == pytest.approx((below + (same + 1) / 2) / len(known))
    marks = place(df, ["v", "w"], ranges).quantiles({"a": ("w", 0.5), "b": ("v", 0.25)})
    finite = [x for x in known]
    assert marks["a"] == np.quantile(w, 0.5) and marks["b"] == pytest.approx(np.quantile(finite, 0.25))


@pytest.mark.parametrize("ranges", [2, 9, 60])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_with_half_the_rows_on_one_key(spark, ranges, strict):
    rng = random.Random(ranges)
    left = [("hot" if i % 2 else rng.choice(["a", "b", None, "zz"]), rng.randint(1, 60), i) for i in range(160)]
    right = sorted({("hot" if i % 2 else rng.choice(["a", "b", None]), rng.randint(1, 60)) for i in range(70)}, key=str)
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c))
    lefts = spark.createDataFrame(left, "k string, d int, id int").withColumn("t", day("d"))
    rights = spark.createDataFrame([(k, d, f"{k}{d}") for k, d in right], "k string, e int, v string").withColumn("u", day("e"))
    got = asof_join(lefts, rights, ["k"], "t", "u", values=["v"], strict=strict, hot_keys=True, ranges=ranges)
    plain = asof_join(lefts, rights, ["k"], "t", "u", values=["v"], strict=strict)
    assert got.columns == plain.columns
    found = {r.id: r.v for r in got.collect()}
    assert len(found) == 160 and found == {r.id: r.v for r in plain.collect()}
    for k, d, i in left:
        days = [e for j, e in right if j == k and (e < d if strict else e <= d)]
        assert found[i] == (f"{k}{max(days)}" if days else None)


def test_no_range_of_an_asof_join_holds_a_whole_hot_key(spark):
    from shelfspan.operators.ordering import dealt_by_range

    df = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") % 50).alias("t"), "id")
    sizes = [r["count"] for r in dealt_by_range(df, ["k", "t", "id"], 16).groupBy("_range").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1000


def groups_by_hand(rows, least=5):
    seen, label = {}, {}
    for s, k, d, v in rows:
        seen.setdefault(s, {})[k, d] = v
        label[s] = s
    close = lambda x, y: abs(x - y) <= 1e-8 + 1e-5 * abs(y)
    for a, b in itertools.combinations(sorted(seen), 2):
        common = seen[a].keys() & seen[b].keys()
        if len(common) >= least and all(close(seen[a][c], seen[b][c]) for c in common):
            old, new = sorted((label[a], label[b]), reverse=True)
            label = {s: new if x == old else x for s, x in label.items()}
    return label


@pytest.mark.parametrize("seed", range(4))
def test_pools_with_near_values_little_overlap_and_disagreement(spark, seed):
    rng = random.Random(seed)
    rows = []
    for store in range(18):
        pool = store % 3
        for sku, day in itertools.product(range(8), range(1, 6)):
            if rng.random() < (0.12 if store % 5 == 4 else 0.6):
                value = 1000.0 * (pool + 1) + 10 * sku + day if sku else 0.0
                value *= 1 + rng.choice([-1, 0, 1]) * 2e-6
                if seed % 2 and store % 6 == 5 and sku == 3:
                    value += 50
                rows.append((f"S{store:02d}", f"K{sku}", day, value))
    df = spark.createDataFrame(rows, "store_id string, sku_uid string, d int, warehouse_stock double").selectExpr(
        "store_id", "sku_uid", "date_add(date'2024-01-01', d) as date", "warehouse_stock")
    assert {r.store_id: r.pool for r in network.store_groups(df).collect()} == groups_by_hand(rows)


def test_a_zone_of_two_dcs_is_an_error(spark):
    stores = spark.createDataFrame([("S1", "east "), ("S2", "WEST"), ("S3", "north")], "store_id string, ZONE string")
    dcs = lambda zones: spark.createDataFrame([(0, "A", ["East"]), (1, "B", zones)], "position int, dc_id string, serves_zones array<string>")
    got = {r.store_id: (r.dc_id, r.mapped) for r in network.dc_of_store(stores, dcs(["west"])).collect()}
    assert got == {"S1": ("A", True), "S2": ("B", True), "S3": ("A", False)}
    with pytest.raises(Exception, match="zone EAST is served by A and B"):
        network.dc_of_store(stores, dcs(["west", " east"])).collect()
    assert [r.zone for r in network.ambiguous_zones(dcs(["west", " east"])).collect()] == ["EAST"]


@pytest.mark.parametrize("mean,k", [(0.3, 0.7), (18.0, 2.5), (250.0, 0.05), (1e6, 2.5), (1e6, 1e5)])
@pytest.mark.parametrize("q", [0.05, 0.8, 0.99])
def test_demand_quantile_whatever_its_size(spark, mean, k, q):
    at = int(spark.range(1).select(policy.negative_binomial_quantile(F.lit(mean), F.lit(k), q).alias("x")).first().x)
    j = np.arange(0, at + 2, dtype=float)
    steps = np.log((j[:-1] + k) / (j[:-1] + 1)) + math.log(mean / (k + mean))
    logs = k * math.log(k / (k + mean)) + np.concatenate(([0.0], np.cumsum(steps)))
    reached = np.cumsum(np.exp(logs))
    tolerance = 1e-7
    assert reached[at] >= q - tolerance and (at == 0 or reached[at - 1] < q + tolerance)


def test_cox_sums_against_risk_sets(spark):
    rng = np.random.default_rng(8)
    x, t, e = rng.normal(size=(400, 3)), rng.integers(1, 90, 400).astype(float), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(*map(float, r), float(a), int(b)) for r, a, b in zip(x, t, e)], "a double, b double, c double, duration_model double, stockout_event int")
    beta = np.array([0.4, -0.3, 0.1])
    value, slope, curve = fit.cox_sums(df.repartition(5), ["a", "b", "c"], beta)
    want, gradient, hessian = 0.0, np.zeros(3), np.zeros((3, 3))
    for i in np.flatnonzero(e):
        risk = t >= t[i]
        w = np.exp(x[risk] @ beta)
        m = (w[:, None] * x[risk]).sum(0) / w.sum()
        want += x[i] @ beta - math.log(w.sum())
        gradient += x[i] - m
        hessian -= (w[:, None, None] * x[risk][:, :, None] * x[risk][:, None, :]).sum(0) / w.sum() - np.outer(m, m)
    assert value == pytest.approx(want) and slope == pytest.approx(gradient) and curve == pytest.approx(hessian)


def test_imbalances_add_up_to_the_pairs(spark):
    rng = random.Random(3)
    banded = spark.createDataFrame([(f"S{i}", f"K{i % 3}", rng.choice(["Critical", "High", "Low"]), float(rng.randint(1, 9))) for i in range(40)],
                                   "store_id string, sku_uid string, risk_band string, expected_lost_revenue double")
    stores = spark.createDataFrame([(f"S{i}", f"Z{i % 4}") for i in range(40)], "store_id string, zone_norm string")
    donors = spark.createDataFrame([(f"K{k}", f"S{i}", float(1 + i % 6), f"Z{i % 4}") for i in range(40) for k in range(3) if rng.random() < 0.4],
                                   "sku_uid string, donor_store string, donor_surplus double, scope_key string")
    zone = {r.store_id: r.zone_norm for r in stores.collect()}
    pairs = [(-b.expected_lost_revenue, b.store_id, b.sku_uid, -d.donor_surplus, d.donor_store) for b in banded.collect() if b.risk_band != "Low"
             for d in donors.collect() if d.sku_uid == b.sku_uid and d.scope_key == zone[b.store_id] and d.donor_store != b.store_id]
    total = X.imbalance_totals(banded, donors, stores).first()
    assert (total.positions, total.surplus) == (len(pairs), -sum(p[3] for p in pairs))
    for top in (1, 7, 500):
        got = [(-r.expected_lost_revenue, r.store_id, r.sku_uid, -r.surplus, r.donor_store) for r in X.imbalance(banded, donors, stores, top=top).collect()]
        assert got == sorted(pairs)[:top]
    none = X.imbalance_totals(banded.limit(0), donors, stores).first()
    assert (none.positions, none.surplus) == (0, None)


def test_feed_pages_follow_each_other(spark):
    rows = [(f"S{i % 7}", f"K{i}", P.REBALANCE if i % 3 else P.NO_ACTION, float(i % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "store_id string, sku_uid string, recommended_action string, expected_net_value double")
    after, got = None, []
    while True:
        page = X.feed_page(df, 8, after=after, action=P.REBALANCE)
        got += [(-r.expected_net_value, r.store_id, r.sku_uid) for r in page.collect()]
        after = X.page_end(page)
        if after is None:
            break
    assert got == sorted((-v, s, k) for s, k, a, v in rows if a == P.REBALANCE)


def test_scenario_stands_beside_the_standing_list(spark):
    schema = "store_id string, sku_uid string, recommended_action string, rebalance_donor string, expected_units_saved double, expected_net_value double"
    standing = spark.createDataFrame([("S1", "K", P.REBALANCE, "S2", 3.0, 50.0), ("S2", "K", P.NO_ACTION, "", 0.0, 0.0), ("S3", "K", P.REBALANCE, "S2", 1.0, 9.0)], schema)
    scenario = spark.createDataFrame([("S1", "K", P.NO_ACTION, "", 0.0, 0.0), ("S2", "K", P.NO_ACTION, "", 0.0, 0.0)], schema)
    both = X.beside_standing(standing, scenario)
    assert {r.store_id: (r.changed, r.value_change) for r in both.collect()} == {"S1": (True, -50.0), "S2": (False, 0.0), "S3": (True, -9.0)}
    one = X.scenario_delta(both).first()
    assert (one.positions, one.changed, one.standing_no_action_share, one.scenario_no_action_share, one.standing_net_value) == (2, 1, 0.5, 1.0, 50.0)


def test_finding_totals_and_filters(spark):
    found = spark.createDataFrame([("a", "t", True, "error"), ("b", "t", False, "error"), ("c", "u", False, "warn")], "check string, table string, passed boolean, severity string")
    totals = {(r.severity, r.passed, r.table): (r.n_checks, r.n_failed, r.n_blocking) for r in Q.finding_totals(found).collect()}
    assert totals[None, None, None] == (3, 2, 1) and totals["error", None, None] == (2, 1, 1) and totals[None, None, "u"] == (1, 1, 0)
    assert [r.check for r in Q.filter_findings(found, severity="error", passed=False).collect()] == ["b"]
    assert Q.filter_findings(found).count() == 3


def test_backtest_date_has_room_and_is_inside_the_panel(spark):
    inventory = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-02-10', interval 1 day)) AS date")
    pick = lambda **k: str(panel_ops.backtest_date(inventory, 14, **k))
    assert pick() == "2024-01-27" and pick(requested="2024-01-05") == "2024-01-05"
    for wrong in ("2023-12-31", "2024-01-28", "no day"):
        with pytest.raises(ValueError):
            pick(requested=wrong)


def test_an_export_is_replaced_in_one_step(spark, tmp_path):
    folder = str(tmp_path)
    first = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    told = sinks.publish(first, folder, "rank", {"estimator": "x"})
    assert told["n_rows"] == 2 and sinks.manifest(spark, folder, "rank")["about"] == {"estimator": "x"}
    opened = sinks.published(spark, folder, "rank")

    def broken(batches):
        raise RuntimeError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        sinks.publish(first.mapInPandas(broken, "n int, s string"), folder, "rank")
    assert sorted(map(tuple, sinks.published(spark, folder, "rank").collect())) == [(1, "a"), (2, None)]
    for _ in range(3):
        sinks.publish(first.limit(0).unionByName(spark.createDataFrame([(9, "z")], "n int, s string")), folder, "rank")
    assert [tuple(r) for r in sinks.published(spark, folder, "rank").collect()] == [(9, "z")]
    assert len(list((tmp_path / "rank" / "versions").iterdir())) <= 3
    assert opened.schema == first.schema
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, folder, "policy")


@pytest.mark.parametrize("width", [64, 300, 10_000_000])
def test_quoted_files_in_many_ranges(spark, tmp_path, width):
    rng = random.Random(width)
    cell = lambda: "".join(rng.choice(['a', 'b', '"', ",", "\n", " x", "é"]) for _ in range(rng.randint(1, 30))) + "."
    rows = [(str(i), cell(), cell() if i % 7 else "") for i in range(200)] + [("200", "long\n" * 400 + ".", "z")]
    for name, part in (("one.csv", rows[:120]), ("two.csv", rows[120:])):
        with open(tmp_path / name, "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["id", "a", "b"])
            writer.writerows(part)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    try:
        got = sorted(tuple(c or "" for c in r) for r in read_table(spark, str(tmp_path), ["id", "a", "b"]).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == sorted(rows)


FREED = """
import glob, sys, time
from pyspark.sql import SparkSession, functions as F
from shelfspan.session import cut_lineage

folder = sys.argv[1]
conf = {"spark.local.dir": folder + "/local", "spark.sql.warehouse.dir": folder + "/warehouse", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
left = lambda: glob.glob(folder + "/local/**/shuffle_*", recursive=True)
before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
kept = cut_lineage(df)
until = time.time() + 20
while left() and time.time() < until:
    time.sleep(0.2)
assert not left(), left()
assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect())) and kept.count() == 7
assert left()
"""


def test_a_cut_leaves_no_shuffle_files(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    subprocess.run([sys.executable, "-c", FREED, str(tmp_path)], check=True, timeout=120, env=env)
