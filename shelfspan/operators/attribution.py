"""Exact decomposition of the AFT prediction into features, in log time and in days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan import params as P

CANCELLED = 1e-9


def reference_point(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Training means: one number per feature."""
    row = train.agg(*[F.avg(c).alias(c) for c in features]).first()
    return {c: float(row[c]) for c in features}


def reference_median(model, reference: dict[str, float]) -> float:
    return math.exp(model.intercept + sum(b * reference[n] for n, b in zip(model.features, model.coefficients)))


def _parts(model, reference) -> dict[str, Column]:
    return {n: F.lit(b) * (F.col(n).cast("double") - F.lit(reference[n])) for n, b in zip(model.features, model.coefficients)}


def contributions(frame: DataFrame, model, reference: dict[str, float], prefix: str = "c_") -> DataFrame:
    """One column per feature; a row's columns sum to its mu minus the reference mu."""
    return frame.withColumns({f"{prefix}{n}": c for n, c in _parts(model, reference).items()})


def contribution_days(frame: DataFrame, model, reference: dict[str, float], prefix: str = "d_") -> DataFrame:
    """The gap between the row's and the reference median, shared out in proportion."""
    parts = _parts(model, reference)
    total = sum(parts.values(), F.lit(0.0))
    gap = model.median() - F.lit(reference_median(model, reference))
    rate = F.when(F.abs(total) > CANCELLED, gap / total).otherwise(0.0)
    return frame.withColumn("_rate", rate).withColumns({f"{prefix}{n}": c * F.col("_rate") for n, c in parts.items()}).drop("_rate")


def top_drivers(frame: DataFrame, columns: dict[str, str], n: int = 3, actionable_only: bool = True) -> DataFrame:
    """``driver_i`` and its effect: the most negative columns, blank where a feature helps.

    ``columns`` maps a feature to the column holding its effect.
    """
    kept = {f: c for f, c in columns.items() if not (actionable_only and f in P.NON_ACTIONABLE)}
    effects = F.array(*[F.struct(F.col(c).alias("effect"), F.lit(i).alias("place"), F.lit(f).alias("name")) for i, (f, c) in enumerate(kept.items())])
    frame = frame.withColumn("_worst", F.array_sort(F.filter(effects, lambda e: e["effect"] < 0)))
    for i in range(min(n, len(kept))):
        worst = F.get("_worst", F.lit(i))
        frame = frame.withColumns({f"driver_{i + 1}": F.coalesce(worst["name"], F.lit("")), f"driver_{i + 1}_effect": worst["effect"]})
    return frame.drop("_worst")


def explain(frame: DataFrame, model, reference: dict[str, float], n: int = 3) -> DataFrame:
    days = contribution_days(frame, model, reference, prefix="_d_")
    drivers = top_drivers(days, {f: f"_d_{f}" for f in model.features}, n)
    rounded = {c: F.round(c, 2) for c in drivers.columns if c.startswith("driver_") and c.endswith("_effect")}
    return drivers.drop(*[f"_d_{f}" for f in model.features]).withColumns({
        "predicted_median_days": F.round(model.median(), 2),
        "reference_median_days": F.lit(round(reference_median(model, reference), 2)), **rounded,
    })


def driver_summary(frame: DataFrame, model, reference: dict[str, float], n: int = 3) -> DataFrame:
    """How often each feature is among the top drivers, its coefficient and its share of rows."""
    raw = contributions(frame, model, reference, prefix="_c_")
    drivers = top_drivers(raw, {f: f"_c_{f}" for f in model.features}, n)
    names = [c for c in drivers.columns if c.startswith("driver_") and not c.endswith("_effect")]
    rows = frame.agg(F.count("*").alias("n")).scalar()
    weights = F.create_map(*[F.lit(v) for pair in zip(model.features, model.coefficients) for v in pair])
    return (
        drivers.select(F.explode(F.array(*names)).alias("feature")).filter("feature <> ''")
        .groupBy("feature").agg(F.count("*").alias("times_top_driver"))
        .withColumns({"coefficient": F.try_element_at(weights, F.col("feature")), "share_of_rows": F.round(F.col("times_top_driver") / rows, 4)})
    )
