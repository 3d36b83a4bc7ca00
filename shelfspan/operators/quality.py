"""Declared invariants and stock accounting: one findings row per check.

Row rules of one table share a single aggregation, so a table is scanned once however
many rules it carries; only group rules add a pass of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspan import params as P
from shelfspan.functions import values as V
from shelfspan.operators.asof import asof_join
from shelfspan.operators.panel import PAIR, movements

FINDING = ["check", "table", "passed", "severity", "summary", "n_bad", "n_total", "bad_rate", "examples", "detail"]


def _number(df: DataFrame, name: str) -> Column:
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return F.col(f"`{name}`").cast("double") if numeric else V.number(F.col(f"`{name}`"))


def _day(df: DataFrame, name: str) -> Column:
    return F.col(name) if isinstance(df.schema[name].dataType, T.DateType) else V.parse_date(F.col(f"`{name}`"))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _present(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def _finding(rule: dict, table: str, n_bad: Column, n_total: Column, examples: Column, severity: str,
             detail: str = "", passed: Column | None = None) -> Column:
    name = f"accounting.{rule['name']}"
    ok = (n_bad == 0) if passed is None else passed
    summary = F.concat(n_bad.cast("string"), F.lit(" of "), n_total.cast("string"), F.lit(f" break {rule['name']}"))
    return F.struct(
        F.lit(name).alias("check"), F.lit(table).alias("table"), ok.alias("passed"), F.lit(severity).alias("severity"),
        F.when(ok, F.lit(f"{rule['name']} holds")).otherwise(summary).alias("summary"),
        n_bad.cast("bigint").alias("n_bad"), n_total.cast("bigint").alias("n_total"),
        F.coalesce(n_bad / F.nullif(n_total, F.lit(0)), F.lit(0.0)).alias("bad_rate"),
        F.coalesce(examples, F.lit("")).alias("examples"), F.lit(rule.get("note", detail)).alias("detail"),
    )


def _unverifiable(rule: dict, table: str, passed: bool, severity: str) -> Column:
    zero = F.lit(0)
    return _finding(rule, table, zero, zero, F.lit(""), severity, "columns are not all present", F.lit(passed))


def _sum_equals(df, table, rule):
    if set(_present(df, [*rule["parts"], rule["total"]])) != {*rule["parts"], rule["total"]}:
        return _unverifiable(rule, table, False, "warn")
    off = F.abs(reduce(lambda a, b: a + b, [_number(df, c) for c in rule["parts"]]) - _number(df, rule["total"]))
    bad = off > P.STOCK_TOLERANCE
    worst = F.max(F.when(bad, off))
    return _finding(rule, table, _count(bad), F.count(F.lit(1)), F.concat(F.lit("diff="), worst.cast("string")),
                    rule.get("severity", "error"))


def _ratio_equals(df, table, rule):
    needed = [*rule["numerator"], rule["denominator"], rule["result"]]
    if len(_present(df, needed)) < len(needed):
        return _unverifiable(rule, table, True, "info")
    below = _number(df, rule["denominator"])
    above = reduce(lambda a, b: a + b, [_number(df, c) for c in rule["numerator"]])
    expected = F.when(below > 0, above / below * float(rule.get("scale", 1)))
    off = F.abs(expected - _number(df, rule["result"]))
    bad = off > float(rule.get("tolerance", 0.01))
    return _finding(rule, table, _count(bad), F.count(off), F.concat(F.lit("off by "), F.max(F.when(bad, off)).cast("string")),
                    rule.get("severity", "warn"))


def _over_columns(df, table, rule, is_bad, severity):
    names = _present(df, rule["columns"])
    n_bad = reduce(lambda a, b: a + b, [_count(is_bad(_number(df, c))) for c in names], F.lit(0))
    lowest = F.concat_ws(", ", *[F.when(_count(is_bad(_number(df, c))) > 0, F.lit(c)) for c in names])
    return _finding(rule, table, n_bad, F.count(F.lit(1)) * max(len(names), 1), lowest, rule.get("severity", severity))


def _non_negative(df, table, rule):
    return _over_columns(df, table, rule, lambda c: c < 0, "error")


def _positive(df, table, rule):
    return _over_columns(df, table, rule, lambda c: c.isNull() | (c <= 0), "warn")


def _not_constant(df, table, rule):
    names = _present(df, rule["columns"])
    rows = F.count(F.lit(1))

    def constant(name):
        c = F.col(f"`{name}`")
        one_value = (F.min(c) == F.max(c)) & (F.count(c) == rows)
        return ((rows > 1) & (F.coalesce(one_value, F.lit(False)) | (F.count(c) == 0))).cast("int")

    n_bad = reduce(lambda a, b: a + b, [constant(c) for c in names], F.lit(0))
    which = F.concat_ws(", ", *[F.when(constant(c) == 1, F.lit(c)) for c in names])
    return _finding(rule, table, n_bad, F.lit(len(names)), which, rule.get("severity", "error"))


def _date_order(df, table, rule):
    if len(_present(df, [rule["earlier"], rule["later"]])) < 2:
        return _unverifiable(rule, table, True, "info")
    before, after = _day(df, rule["earlier"]), _day(df, rule["later"])
    return _finding(rule, table, _count(after < before), _count(before.isNotNull() & after.isNotNull()), F.lit(""),
                    rule.get("severity", "error"))


ROW_RULES = {
    "sum_equals": _sum_equals, "ratio_equals": _ratio_equals, "non_negative": _non_negative, "positive": _positive,
    "not_constant": _not_constant, "date_order": _date_order,
}


def _constant_within_group(df: DataFrame, table: str, rule: dict) -> DataFrame:
    if len(_present(df, [*rule["group"], rule["column"]])) < len(rule["group"]) + 1:
        return df.agg(_unverifiable(rule, table, True, "info").alias("f")).select("f.*")
    groups = df.groupBy(*rule["group"]).agg(
        F.min(rule["column"]).alias("lo"), F.max(rule["column"]).alias("hi"), F.count("*").alias("k")
    )
    n_bad = F.coalesce(F.sum(F.when(F.col("lo") != F.col("hi"), F.col("k"))), F.lit(0))
    found = _finding(rule, table, n_bad, F.coalesce(F.sum("k"), F.lit(0)), F.lit(""), rule.get("severity", "warn"))
    return groups.agg(found.alias("f")).select("f.*")


def table_invariants(df: DataFrame, table: str, rules: list[dict]) -> DataFrame | None:
    """Findings of every declared rule of one table."""
    row_rules = [r for r in rules if r["type"] in ROW_RULES]
    parts = [_constant_within_group(df, table, r) for r in rules if r["type"] == "constant_within_group"]
    if row_rules:
        found = F.array(*[ROW_RULES[r["type"]](df, table, r) for r in row_rules])
        parts.append(df.agg(found.alias("f")).select(F.inline("f")))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def stock_movement(panel: DataFrame) -> DataFrame:
    """Every fall across consecutive days must be explained by a sale."""
    lost = F.col("comparable") & (F.col("implied_receipt") < -P.STOCK_TOLERANCE)
    found = _finding({"name": "stock_movement_sign"}, "inventory_daily", _count(lost), _count(F.col("comparable")),
                     F.concat(F.lit("max "), F.max(F.when(lost, -F.col("implied_receipt"))).cast("string")), "error")
    return movements(panel).agg(found.alias("f")).select("f.*")


def receipt_attribution(panel: DataFrame, orders: DataFrame, lookback: int = P.RECEIPT_LOOKBACK_DAYS) -> DataFrame:
    """Share of inferred receipts that follow an order within the lookback; no receipts, no row."""
    receipts = movements(panel).filter(F.col("comparable") & (F.col("implied_receipt") > P.STOCK_TOLERANCE)).select(*PAIR, "date")
    matched = asof_join(receipts, orders.withColumnRenamed("date", "order_date"), PAIR, "date", "order_date",
                        tolerance_days=lookback)
    n, missed = F.count(F.lit(1)), _count(F.col("order_date").isNull())
    enough = (n - missed) / F.nullif(n, F.lit(0)) >= P.RECEIPT_MATCH_THRESHOLD
    found = _finding({"name": "receipt_attribution"}, "inventory_daily", missed, n, F.lit(""), "warn",
                     passed=F.coalesce(enough, F.lit(True)))
    return matched.agg(found.alias("f")).select("f.*").filter("n_total > 0")


def phantom_stockout(panel: DataFrame, orders: DataFrame, lookback: int = P.RECEIPT_LOOKBACK_DAYS) -> DataFrame:
    """Sales on a day that opened empty with no order in the lookback to explain a delivery."""
    moved = movements(panel)
    suspects = moved.filter(F.col("comparable") & (F.col("prev_stock") <= 0) & (F.col("units_sold") > 0)).select(*PAIR, "date")
    matched = asof_join(suspects, orders.withColumnRenamed("date", "order_date"), PAIR, "date", "order_date",
                        tolerance_days=lookback)
    total = moved.agg(_count(F.col("comparable")).alias("n")).scalar()
    unexplained = F.col("order_date").isNull()
    example = F.min(F.when(unexplained, F.concat_ws("/", *PAIR, F.col("date").cast("string"))))
    counted = matched.agg(_count(unexplained).alias("bad"), example.alias("example"))
    found = _finding({"name": "phantom_stockout"}, "inventory_daily", F.col("bad"), total, F.col("example"), "error")
    return counted.select(found.alias("f")).select("f.*")


def unexplained_movement(panel: DataFrame) -> DataFrame:
    """Size of the stock that leaves with no sale behind it."""
    loss = F.when(F.col("comparable") & (F.col("implied_receipt") < -P.STOCK_TOLERANCE), -F.col("implied_receipt")).otherwise(0.0)
    return movements(panel).withColumn("loss", loss).agg(
        _count(F.col("comparable")).alias("transitions"),
        F.count_if(F.col("loss") > 0).alias("unexplained_loss_events"),
        F.sum("loss").alias("unexplained_loss_units"),
        F.coalesce(F.sum("loss") / F.nullif(F.sum("units_sold"), F.lit(0.0)), F.lit(0.0)).alias("unexplained_share_of_sales"),
        F.max("loss").alias("worst_single_loss"),
    )


def findings(parts: list[DataFrame]) -> DataFrame:
    """All findings, failures first, then by severity, table and check."""
    order = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(v) for kv in P.SEVERITY_ORDER.items() for v in kv]), F.col("severity")), F.lit(9))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("passed", order, "table", "check")


def filter_findings(found: DataFrame, severity: str | None = None, passed: bool | None = None, table: str | None = None) -> DataFrame:
    """The findings shown; a filter that is not given lets everything through."""
    for column, wanted in (("severity", severity), ("passed", passed), ("table", table)):
        if wanted is not None:
            found = found.filter(F.col(column) == wanted)
    return found


def finding_totals(found: DataFrame) -> DataFrame:
    """Checks, failed ones and blocking ones: over all, per severity, per outcome, per table and per all three.

    One pass: a total's columns that it does not group by are null.
    """
    by = [F.col(c) for c in ("severity", "passed", "table")]
    failed = ~F.col("passed")
    return found.groupingSets([[], [by[0]], [by[1]], [by[2]], by], *by).agg(
        F.count("*").alias("n_checks"), F.count_if(failed).alias("n_failed"), F.count_if(failed & (F.col("severity") == "error")).alias("n_blocking"))


def duplicate_grain(df: DataFrame, grain: list[str]) -> DataFrame:
    return df.groupBy(*grain).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def common_window(tables: dict[str, DataFrame]) -> DataFrame:
    """First and last day of every table, and whether all tables share them."""
    parts = [t.agg(F.lit(n).alias("table"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
             for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def reference_rate(child: DataFrame, parent: DataFrame, key: str, name: str, threshold: float = P.REFERENTIAL_THRESHOLD) -> DataFrame:
    """Share of child rows whose key exists in the parent, counted over distinct keys first."""
    keys = child.groupBy(key).agg(F.count("*").alias("_k"))
    known = parent.select(F.col(key).alias("_key"), F.lit(True).alias("_known")).filter(F.col("_key").isNotNull()).distinct()
    matched = keys.join(known, F.col(key) == F.col("_key"), "left")
    n, hit = F.sum("_k"), F.coalesce(F.sum(F.when(F.col("_known"), F.col("_k"))), F.lit(0))
    return matched.agg(F.lit(name).alias("check"), n.alias("n_total"), (n - hit).alias("n_bad"), (hit / n).alias("match_rate"),
                       (hit / n >= threshold).alias("passed"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")
