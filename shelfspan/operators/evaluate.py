"""Held-out evaluation: concordance, weighted Brier score and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.operators.fit import EVENT, TIME
from shelfspan.operators.ordering import ordered_pairs, quantiles
from shelfspan.operators.survival import kaplan_meier

CENSORING_FLOOR = 1e-3


def concordance(frame: DataFrame, score: Column) -> DataFrame:
    """Harrell's C for a score that is higher where the position is safer.

    A pair counts when the earlier one ran out; a censored spell of the same length is
    the later one, two stockouts of the same length do not count.
    """
    longest = frame.agg(F.max(TIME).alias("m")).first()["m"] or 0.0
    coded = frame.select(
        ((F.col(TIME) * 2).cast("int") * 2 + (1 - F.col(EVENT))).alias("code"), score.alias("score"),
        (F.col(EVENT) == 1).alias("starts"), F.lit(1).alias("w"),
    )
    counted = ordered_pairs(coded, "code", "score", "starts", "w", codes=int(longest * 4) + 2)
    return counted.withColumn("c_index", (F.col("concordant") + F.col("tied") / 2) / F.nullif(F.col("pairs"), F.lit(0)))


def brier(frame: DataFrame, predicted: Column, horizon: float) -> DataFrame:
    """Squared error at the horizon, weighted by the inverse chance of still being observed."""
    observed = kaplan_meier(frame, duration=TIME, event=1 - F.col(EVENT)).select(F.col("t").alias(TIME), "survival")
    at_horizon = F.coalesce(observed.filter(F.col(TIME) <= horizon).agg(F.min("survival").alias("s")).scalar(), F.lit(1.0))
    failed = (F.col(TIME) <= horizon) & (F.col(EVENT) == 1)
    weight = (
        F.when(failed, 1 / F.greatest("survival", F.lit(CENSORING_FLOOR)))
        .when(F.col(TIME) > horizon, 1 / F.greatest(at_horizon, F.lit(CENSORING_FLOOR))).otherwise(0.0)
    )
    error = failed.cast("double") - F.col("_p")
    return (
        frame.withColumn("_p", predicted).join(observed, TIME).withColumn("_w", weight)
        .agg((F.sum(F.col("_w") * error * error) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("brier"))
    )


def calibration_table(frame: DataFrame, predicted: Column, horizon: float, bins: int = 10) -> DataFrame:
    """Mean predicted against observed (one minus Kaplan-Meier) per quantile bin of the prediction."""
    scored = frame.withColumn("predicted", predicted)
    edges = quantiles(scored, "predicted", {f"q{i}": i / bins for i in range(bins + 1)}).first()
    inner = sorted(set(edges))[1:-1] if edges[0] is not None else []
    placed = scored.withColumn("bin", sum(((F.col("predicted") > e).cast("int") for e in inner), F.lit(0)))
    curve = kaplan_meier(placed, duration=TIME, event=F.col(EVENT), by=["bin"]).filter(F.col("t") <= horizon)
    reached = curve.groupBy("bin").agg(F.min("survival").alias("s"))
    sizes = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("predicted").alias("predicted_mean"))
    return sizes.join(reached, "bin", "left").select(
        "bin", "n", "predicted_mean", (1 - F.coalesce("s", F.lit(1.0))).alias("observed_km")
    ).withColumn("gap", F.col("predicted_mean") - F.col("observed_km"))


def evaluate_model(train: DataFrame, test: DataFrame, model, label: str, horizons=(7, 14, 28)) -> DataFrame:
    """One row of metrics; frames that are read this often should be materialised first."""
    safer = model.median()
    calibrated = calibration_table(test, model.event_probability(horizons[1]), horizons[1])
    columns = [
        F.lit(label).alias("model"), train.agg(F.count("*").alias("n")).scalar().alias("n_train"), F.count("*").alias("n_test"),
        F.coalesce(train.agg(F.sum(EVENT).alias("n")).scalar(), F.lit(0)).alias("events_train"), F.sum(EVENT).alias("events_test"),
    ]
    one = test.agg(*columns).withColumns({
        "c_index_train": concordance(train, safer).select("c_index").scalar(),
        "c_index_test": concordance(test, safer).select("c_index").scalar(),
        **{f"brier_{h}d": brier(test, model.event_probability(h), h).scalar() for h in horizons},
        "calibration_max_gap": calibrated.agg(F.max(F.abs("gap")).alias("g")).scalar(),
    })
    return one


def compare_models(train: DataFrame, test: DataFrame, models: dict) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [evaluate_model(train, test, m, label) for label, m in models.items()])
