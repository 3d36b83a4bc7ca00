"""Spells: unbroken runs of days with stock, and how each of them ended.

``competing`` lets a delivery on a stocked shelf close one spell and open the next;
``depletion`` ignores deliveries inside a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan import params as P
from shelfspan.operators.panel import PAIR

SPELL_COLUMNS = [
    "store_id", "sku_uid", "spell_id", "spell_start", "spell_end", "duration", "event",
    "end_reason", "left_truncated", "start_stock", "units_sold_in_spell",
]


def build_spells(panel: DataFrame, mode: str = "competing") -> DataFrame:
    """Gaps and islands over each pair; every step stays on the pair's own partition."""
    if mode not in ("competing", "depletion"):
        raise ValueError(f"mode must be 'competing' or 'depletion', got {mode!r}")
    by_day = Window.partitionBy(*PAIR).orderBy("date")
    days = panel.filter(F.col("date").isNotNull()).select(
        *PAIR, "date",
        F.coalesce(F.col("store_stock"), F.lit(0.0)).alias("on_hand"),
        F.coalesce(F.col("received"), F.lit(0.0)).alias("received"),
        F.coalesce(F.col("units_sold"), F.lit(0.0)).alias("units"),
    )
    before = F.lag("on_hand").over(by_day)
    opens = before.isNull() | (before <= 0)
    if mode == "competing":
        opens = opens | (F.col("received") > 0)
    marked = days.withColumn("_opens", ((F.col("on_hand") > 0) & opens).cast("int"))
    upto = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("spell_id", F.sum("_opens").over(upto))
    seen = numbered.withColumns({
        "_next_date": F.lead("date").over(by_day),
        "_next_stock": F.lead("on_hand").over(by_day),
        "_next_id": F.lead("spell_id").over(by_day),
        "_pair_start": F.min("date").over(Window.partitionBy(*PAIR)),
    })
    runs = seen.filter("on_hand > 0").groupBy(*PAIR, "spell_id").agg(
        F.min("date").alias("spell_start"),
        F.max("date").alias("_last"),
        F.min_by("on_hand", "date").alias("start_stock"),
        F.sum("units").alias("units_sold_in_spell"),
        F.max_by("_next_date", "date").alias("_next_date"),
        F.max_by("_next_stock", "date").alias("_next_stock"),
        F.max_by("_next_id", "date").alias("_next_id"),
        F.min("_pair_start").alias("_pair_start"),
    )
    observed = F.col("_next_date").isNotNull()
    ran_out = observed & (F.col("_next_stock") <= 0)
    topped_up = observed & (F.col("_next_stock") > 0) & (F.col("_next_id") != F.col("spell_id"))
    ended = ran_out | topped_up
    return runs.withColumns({
        "event": ran_out.cast("int"),
        "end_reason": F.when(ran_out, P.END_STOCKOUT).when(topped_up, P.END_REPLENISHED).otherwise(P.END_WINDOW),
        "spell_end": F.when(ended, F.col("_next_date")).otherwise(F.col("_last")),
        "duration": F.when(ended, F.datediff("_next_date", "spell_start"))
        .otherwise(F.datediff("_last", "spell_start") + 1),
        "left_truncated": (F.col("spell_start") == F.col("_pair_start")) & (F.col("spell_id") == 1),
    }).select(*SPELL_COLUMNS)


def relabel_censoring(spells: DataFrame, lifecycle: DataFrame, key: str, reason: str) -> DataFrame:
    """A window-end spell becomes ``reason`` when its effective date is at most a day past the end."""
    effective = lifecycle.groupBy(key).agg(F.min("effective_date").alias("_effective"))
    hit = (F.col("end_reason") == P.END_WINDOW) & (F.col("_effective") <= F.date_add("spell_end", 1))
    return (
        spells.join(effective, key, "left")
        .withColumn("end_reason", F.when(hit, F.lit(reason)).otherwise(F.col("end_reason")))
        .select(*SPELL_COLUMNS)
    )


def summarise_spells(spells: DataFrame) -> DataFrame:
    return spells.agg(
        F.count("*").alias("n_spells"),
        F.coalesce(F.sum("event"), F.lit(0)).alias("n_events"),
        F.avg("event").alias("event_rate"),
        F.median("duration").alias("median_duration"),
        F.avg(F.col("left_truncated").cast("int")).alias("left_truncated_rate"),
        F.avg((F.col("end_reason") == P.END_REPLENISHED).cast("int")).alias("informative_censor_rate"),
    )


def end_reason_counts(spells: DataFrame) -> DataFrame:
    return spells.groupBy("end_reason").agg(F.count("*").alias("n_spells"))


def first_spells(spells: DataFrame) -> DataFrame:
    return spells.filter("spell_id = 1")


def align_arms(observed: DataFrame, counterfactual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First spells of the pairs both arms hold."""
    left, right = first_spells(observed), first_spells(counterfactual)
    return left.join(right, PAIR, "left_semi"), right.join(left, PAIR, "left_semi")


def latest_position(frame: DataFrame) -> DataFrame:
    """The most recently opened spell of each pair."""
    newest = Window.partitionBy(*PAIR).orderBy(F.desc("spell_start"), F.desc("spell_id"))
    return frame.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def latest_known(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Per pair, the last non-null value of each column by spell start."""
    order = F.struct("spell_start", "spell_id")
    return frame.groupBy(*PAIR).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    )


def open_positions(frame: DataFrame, as_of=None) -> DataFrame:
    """Spells running on the scoring date, with the days they have already lasted."""
    day = frame.agg(F.max("spell_end").alias("d")).scalar() if as_of is None else as_of
    return (
        frame.withColumn("as_of", day)
        .filter((F.col("spell_start") <= F.col("as_of")) & (F.col("spell_end") >= F.col("as_of")))
        .withColumn("elapsed_days", F.greatest(F.datediff("as_of", "spell_start"), F.lit(0)))
    )
