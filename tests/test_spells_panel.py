from shelfspan import params as P
from shelfspan.operators import panel as panel_ops
from shelfspan.operators import quality as Q
from shelfspan.operators import spells as S


def rows(df):
    return [r.asDict() for r in df.orderBy("store_id", "sku_uid", "spell_id").collect()]


def test_runs_out(panel_of):
    (one,) = rows(S.build_spells(panel_of([(1, 3, 0, 0), (2, 2, 0, 1), (3, 0, 0, 2)])))
    assert (one["end_reason"], one["duration"], one["event"], one["left_truncated"]) == (P.END_STOCKOUT, 2, 1, True)
    assert one["start_stock"] == 3 and one["units_sold_in_spell"] == 1


def test_delivery_on_stock_opens_a_new_spell(panel_of):
    panel = panel_of([(1, 3, 0, 0), (2, 2, 0, 1), (3, 6, 5, 1), (4, 0, 0, 6)])
    first, second = rows(S.build_spells(panel))
    assert first["end_reason"] == P.END_REPLENISHED and first["duration"] == 2
    assert second["end_reason"] == P.END_STOCKOUT and not second["left_truncated"]
    assert len(rows(S.build_spells(panel, "depletion"))) == 1


def test_window_end_counts_the_last_day(panel_of):
    (one,) = rows(S.build_spells(panel_of([(1, 0, 0, 0), (2, 4, 4, 0), (3, 3, 0, 1)])))
    assert (one["end_reason"], one["duration"], one["event"]) == (P.END_WINDOW, 2, 0)


def test_receipts_are_not_read_across_a_gap(spark, panel_of):
    inventory = panel_of([(1, 3, 0, 0), (2, 5, 0, 0), (5, 9, 0, 0)]).drop("received", "units_sold")
    sales = panel_of([(2, 0, 0, 1)]).drop("received", "store_stock")
    got = {r.date.day: r.received for r in panel_ops.assemble_panel(inventory, sales).collect()}
    assert got == {1: 0.0, 2: 3.0, 5: 0.0}


def test_unexplained_loss_is_found(panel_of):
    found = Q.stock_movement(panel_of([(1, 5, 0, 0), (2, 3, 0, 1), (3, 3, 0, 0)])).first()
    assert (found.passed, found.n_bad, found.n_total) == (False, 1, 2)


def test_phantom_needs_no_recent_order(spark, panel_of):
    panel = panel_of([(1, 0, 0, 0), (2, 0, 0, 2)])
    order = lambda day: spark.sql(f"select 'S1' as store_id, 'K1' as sku_uid, date'2024-01-{day:02d}' as date")
    assert Q.phantom_stockout(panel, order(1)).first().passed
    assert not Q.phantom_stockout(panel, order(3)).first().passed


def test_declared_rules_share_one_row_each(spark):
    df = spark.createDataFrame([("1", "2", "4"), ("1", "1", "2"), ("", "-3", "x")], "a string, b string, total string")
    rules = [{"name": "s", "type": "sum_equals", "parts": ["a", "b"], "total": "total"}, {"name": "n", "type": "non_negative", "columns": ["a", "b"]},
             {"name": "p", "type": "positive", "columns": ["a"]}, {"name": "c", "type": "not_constant", "columns": ["a"]},
             {"name": "r", "type": "ratio_equals", "numerator": ["a"], "denominator": "reach", "result": "b"}]
    got = {r["check"]: (r.passed, r.n_bad) for r in Q.table_invariants(df, "t", rules).collect()}
    assert got == {"accounting.s": (False, 1), "accounting.n": (False, 1), "accounting.p": (False, 1), "accounting.c": (True, 0), "accounting.r": (True, 0)}
