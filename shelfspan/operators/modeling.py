"""The modelling frame: burn-in, outcome columns, one-hot levels, complete rows, time split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan import params as P
from shelfspan.session import cut_lineage

ENCODED = {"zone_norm": "zonecat", "category": "prodcat"}


def modeling_frame(features: DataFrame, burn_in_days: int = P.BURN_IN_DAYS) -> DataFrame:
    """Spells past the burn-in, with the cause-specific outcome and a positive duration."""
    first = features.agg(F.min("spell_start").alias("d")).scalar()
    return features.filter(F.col("spell_start") >= F.date_add(first, burn_in_days)).withColumns({
        "stockout_event": (F.col("end_reason") == P.END_STOCKOUT).cast("int"),
        "censored_by_replenishment": (F.col("end_reason") == P.END_REPLENISHED).cast("int"),
        "duration_model": F.greatest(F.col("duration").cast("double"), F.lit(0.5)),
    })


def _level(column: str) -> Column:
    return F.regexp_replace(F.col(column).cast("string"), r"\W+", "_")


def level_dictionary(frame: DataFrame) -> DataFrame:
    """``name, column, level, place`` of every level but the first of its column, in order.

    A column with one level gives none.  Levels are numbered over all columns, so a place is
    a position in the coefficients of a fit.
    """
    parts = [frame.select(F.lit(i).alias("_at"), F.lit(c).alias("column"), F.lit(prefix).alias("_prefix"), _level(c).alias("level")).distinct()
             for i, (c, prefix) in enumerate(ENCODED.items()) if c in frame.columns]
    if not parts:
        return frame.sparkSession.createDataFrame([], "name string, column string, level string, place int")
    levels = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("level").isNotNull())
    # one row per level: as many as a fit has coefficients
    numbered = levels.withColumn("_n", F.row_number().over(Window.partitionBy("_at").orderBy("level"))).filter("_n > 1")
    place = F.row_number().over(Window.orderBy("_at", "level")) - 1
    return numbered.select(F.concat_ws("_", "_prefix", "level").alias("name"), "column", "level", place.cast("int").alias("place"))


def one_hot(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hot``, the places of a row's levels with value 1, and the dictionary of all places.

    An array holds at most one entry per encoded column, however many levels there are.
    """
    levels = cut_lineage(level_dictionary(frame))
    held = []
    for column, prefix in ENCODED.items():
        if column in frame.columns:
            of_column = levels.filter(F.col("column") == column).select(F.col("level").alias(f"_{prefix}"), F.col("place").alias(f"_{prefix}_at"))
            frame = frame.withColumn(f"_{prefix}", _level(column)).join(of_column, f"_{prefix}", "left")
            held.append(prefix)
    entries = [F.struct(F.col(f"_{p}_at").alias("place"), F.lit(1.0).alias("value")) for p in held]
    hot = F.filter(F.array(*entries), lambda e: e["place"].isNotNull()) if held else F.array().cast("array<struct<place:int,value:double>>")
    return frame.withColumn("hot", hot).drop(*[c for p in held for c in (f"_{p}", f"_{p}_at")]), levels


def complete_cases(frame: DataFrame, features: list[str]) -> DataFrame:
    return frame.dropna(subset=[*features, "duration_model", "stockout_event"])


def split_date(frame: DataFrame, holdout: float = 0.3) -> DataFrame:
    """The start-date quantile, as a timestamp because it may fall inside a day."""
    days = frame.select(F.unix_date("spell_start").cast("double").alias("day"))
    # dates are few, so the exact percentile holds one counter per day
    return days.agg(F.percentile("day", 1 - holdout).alias("split_day"))


def time_split(frame: DataFrame, holdout: float = 0.3) -> DataFrame:
    """``part`` is train before the split and test from it on."""
    at = split_date(frame, holdout).scalar()
    return frame.withColumn("part", F.when(F.unix_date("spell_start") < at, "train").otherwise("test"))


def model_input(open_frame: DataFrame, features: list[str]) -> DataFrame:
    return open_frame.select("store_id", "sku_uid", "spell_id", "spell_start", "as_of", "elapsed_days", *features)


