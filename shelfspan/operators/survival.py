"""Product-limit estimators on durations counted in whole days.

Spells are first reduced to one row per distinct duration (and stratum), so the ordered
windows below run over at most as many rows as the observation window has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan import params as P
from shelfspan.session import cut_lineage

UNSTRATIFIED = "_all"


def _strata(by: list[str] | None) -> list[str]:
    return list(by or [])


def risk_table(
    spells: DataFrame,
    duration: str = "duration",
    event: Column | None = None,
    by: list[str] | None = None,
    entry: str | None = None,
) -> DataFrame:
    """Per distinct time: events ``d``, leavers ``c`` and the number ``n`` still at risk.

    With ``entry`` a spell joins the risk set only after its entry time.
    """
    keys = _strata(by)
    is_event = F.coalesce((F.col("event") if event is None else event).cast("int"), F.lit(0))
    exits = spells.groupBy(*keys, F.col(duration).alias("t")).agg(
        F.sum(is_event).alias("d"), F.count("*").alias("left_at"), F.lit(0).cast("bigint").alias("entered_at")
    )
    if entry is not None:
        entries = spells.filter(F.col(entry) > 0).groupBy(*keys, F.col(entry).alias("t")).agg(
            F.count("*").alias("entered_at")
        )
        exits = (
            exits.unionByName(entries, allowMissingColumns=True)
            .groupBy(*keys, "t")
            .agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("d", "left_at", "entered_at")])
        )
    later = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # still inside at t = everyone leaving at t or later, minus those who only join at t or later
    return exits.withColumn("n", F.sum("left_at").over(later) - F.sum("entered_at").over(later))


def kaplan_meier(
    spells: DataFrame,
    duration: str = "duration",
    event: Column | None = None,
    by: list[str] | None = None,
    entry: str | None = None,
) -> DataFrame:
    """Survival at every time with an exit: ``t, d, n, survival`` per stratum."""
    keys = _strata(by)
    table = risk_table(spells, duration, event, by, entry).filter("left_at > 0")
    upto = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dies_out = F.max((F.col("d") >= F.col("n")).cast("int")).over(upto) == 1
    log_step = F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)
    survival = F.when(dies_out, F.lit(0.0)).otherwise(F.exp(F.sum(log_step).over(upto)))
    return table.withColumn("survival", survival)


def median_survival(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First time survival is at or below one half; null when it never gets there."""
    first = F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).cast("double").alias("median")
    return curve.groupBy(*_strata(by)).agg(first)


def survival_on(curve: DataFrame, times: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Survival carried forward onto other times (``times`` holds the strata and ``t``)."""
    keys = _strata(by)
    stacked = times.select(*keys, "t", F.lit(1).alias("_side")).unionByName(
        curve.select(*keys, "t", F.lit(0).alias("_side"), "survival"), allowMissingColumns=True
    )
    carried = Window.partitionBy(*keys).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.coalesce(F.last("survival", ignorenulls=True).over(carried), F.lit(1.0))
    return stacked.withColumn("survival", value).filter("_side = 1").drop("_side")


def day_spine(spells: DataFrame, duration: str = "duration") -> DataFrame:
    """Days 0 to the longest duration."""
    return spells.agg(F.max(duration).alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m").cast("int"))).alias("t"))


def cumulative_incidence(spells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Both causes and overall survival on every exit time.

    Exits are grouped by whole day, so ties need no jitter and the parts close exactly.
    """
    keys = _strata(by)
    stockout = (F.col("end_reason") == P.END_STOCKOUT).cast("int")
    topped_up = (F.col("end_reason") == P.END_REPLENISHED).cast("int")
    table = spells.groupBy(*keys, F.col("duration").alias("t")).agg(
        F.sum(stockout).alias("d_stockout"), F.sum(topped_up).alias("d_replenished"), F.count("*").alias("left_at")
    )
    ordered = Window.partitionBy(*keys).orderBy("t")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    risk = table.withColumn("n", F.sum("left_at").over(later)).withColumn("d", F.col("d_stockout") + F.col("d_replenished"))
    dies_out = F.max((F.col("d") >= F.col("n")).cast("int")).over(upto) == 1
    log_step = F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)
    curve = risk.withColumn(
        "survival_any", F.when(dies_out, F.lit(0.0)).otherwise(F.exp(F.sum(log_step).over(upto)))
    ).withColumn("_entering", F.coalesce(F.lag("survival_any").over(ordered), F.lit(1.0)))
    return curve.withColumns({
        "cif_stockout": F.sum(F.col("_entering") * F.col("d_stockout") / F.col("n")).over(upto),
        "cif_replenished": F.sum(F.col("_entering") * F.col("d_replenished") / F.col("n")).over(upto),
    }).drop("_entering")


def cif_partition(spells: DataFrame) -> DataFrame:
    """The three parts on every day from zero, and their total, which must be one."""
    curve = cumulative_incidence(spells).select("t", "cif_stockout", "cif_replenished", "survival_any")
    stacked = day_spine(spells).join(curve, "t", "left")
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = lambda c, start: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(start))
    return stacked.select(
        "t", carry("cif_stockout", 0.0).alias("cif_stockout"), carry("cif_replenished", 0.0).alias("cif_replenished"),
        carry("survival_any", 1.0).alias("survival_any"),
    ).withColumn("total", F.col("cif_stockout") + F.col("cif_replenished") + F.col("survival_any"))


def empirical_cif(spells: DataFrame) -> DataFrame:
    """Share of all spells that ran out by each day."""
    by_day = spells.groupBy(F.col("duration").alias("t")).agg(
        F.count_if(F.col("end_reason") == P.END_STOCKOUT).alias("d"), F.count("*").alias("n")
    )
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dense = day_spine(spells).join(by_day, "t", "left").fillna(0, ["d", "n"])
    return dense.select("t", (F.sum("d").over(upto) / F.sum("n").over(everything)).alias("cif"))


def bias_curve(observed: DataFrame, counterfactual: DataFrame) -> DataFrame:
    """Naive survival against the truth on every day both arms reach."""
    stockout = F.col("end_reason") == P.END_STOCKOUT
    naive, truth = kaplan_meier(observed, event=stockout), kaplan_meier(counterfactual, event=stockout)
    reach = F.least(
        observed.agg(F.max("duration").alias("m")).scalar(), counterfactual.agg(F.max("duration").alias("m")).scalar()
    )
    # the spine starts from a one-row aggregate so that nothing synthetic drives it
    days = observed.agg(F.max("duration").alias("m")).select(F.explode(F.sequence(F.lit(0), reach.cast("int"))).alias("t"))
    left = survival_on(naive, days).withColumnRenamed("survival", "naive")
    right = survival_on(truth, days).withColumnRenamed("survival", "truth")
    return left.join(right, "t").withColumn("difference", F.col("naive") - F.col("truth"))


def km_bias(observed: DataFrame, counterfactual: DataFrame) -> DataFrame:
    """One row: medians, their gap, the largest vertical gap and where it sits."""
    stockout = F.col("end_reason") == P.END_STOCKOUT
    # two columns and one row per pair, read many times below
    observed, counterfactual = [cut_lineage(arm.select("duration", "end_reason")) for arm in (observed, counterfactual)]
    curve = bias_curve(observed, counterfactual)
    peak = curve.agg(
        F.max(F.struct(F.abs("difference").alias("size"), (-F.col("t")).alias("back"), F.col("difference").alias("signed"))).alias("p")
    )
    median = lambda arm: median_survival(kaplan_meier(arm, event=stockout)).scalar()
    return peak.select(
        median(observed).alias("median_naive"), median(counterfactual).alias("median_true"),
        F.col("p.size").alias("max_vertical_gap"), (-F.col("p.back")).cast("double").alias("gap_at"),
        F.when(F.col("p.signed") > 0, "optimistic").otherwise("pessimistic").alias("direction"),
        observed.agg(F.count("*").alias("n")).scalar().alias("n_naive"),
        counterfactual.agg(F.count("*").alias("n")).scalar().alias("n_true"),
        observed.agg(F.avg((F.col("end_reason") == P.END_REPLENISHED).cast("int")).alias("s")).scalar().alias("censored_share"),
    ).withColumn("median_gap_days", F.col("median_naive") - F.col("median_true"))
