"""Survival regressions fitted by Newton steps over Spark partitions.

Every task reduces its rows to sums by numpy, Spark adds the sums up, and only a value, a
gradient and a Hessian reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspan.functions import normal
from shelfspan.session import cut_lineage

TIME, EVENT = "duration_model", "stockout_event"
SUMS = "k int, v double"
#: Days that are summed together before totals are carried on.
BLOCK_DAYS = 32


@dataclass(frozen=True)
class AftModel:
    """ln T ~ Normal(intercept + coefficients . x, sigma)."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    sigma: float
    log_likelihood: float = float("nan")
    gradient_norm: float = float("nan")
    trace: list[float] = field(default_factory=list)

    def mu(self) -> Column:
        total = F.lit(self.intercept)
        for name, b in zip(self.features, self.coefficients):
            total = total + F.lit(b) * F.col(name)
        return total

    def median(self) -> Column:
        return F.exp(self.mu())

    def survival(self, t: Column, mu: Column | None = None) -> Column:
        return normal.lognormal_survival(t, self.mu() if mu is None else mu, self.sigma)

    def event_probability(self, horizon: float) -> Column:
        return 1 - self.survival(F.lit(float(horizon)))


@dataclass(frozen=True)
class CoxModel:
    features: list[str]
    coefficients: list[float]
    log_likelihood: float
    gradient_norm: float

    def partial_hazard(self) -> Column:
        return F.exp(sum((F.lit(b) * F.col(n) for n, b in zip(self.features, self.coefficients)), F.lit(0.0)))


def _upper_tail(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P(Z > z) and the hazard, by the same rational form as the column version."""
    a = np.abs(z)
    weight = np.exp(-a * a / 2)
    fraction = a + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = a + step / fraction
    ratio = np.where(a < normal.TAIL_FROM, np.polyval(normal.NUMERATOR, a) / np.polyval(normal.DENOMINATOR, a),
                     1.0 / fraction / normal.ROOT_TWO_PI)
    small = ratio * weight
    log_tail = np.where(z > 0, np.log(ratio) - a * a / 2, np.log1p(-small))
    hazard = np.exp(-z * z / 2 - math.log(math.sqrt(2 * math.pi)) - log_tail)
    return log_tail, hazard


def scale(frame: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and standard deviations of the features, and the row count."""
    row = frame.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                    *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    mean = np.array([row[f"m{i}"] for i in range(len(features))], dtype=float)
    std = np.array([row[f"s{i}"] or 0.0 for i in range(len(features))], dtype=float)
    return mean, np.where(std > 0, std, 1.0), row["n"]


def _collect_sums(frame: DataFrame, reducer, width: int) -> np.ndarray:
    rows = frame.mapInPandas(reducer, SUMS).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for k, v in rows:
        out[k] = v
    return out


def aft_sums(frame: DataFrame, features: list[str], mean, std, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian at ``theta`` (standardised scale, ln sigma last)."""
    d = len(features)
    p = d + 2

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + p + p * p)
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), (batch[features].to_numpy(float) - mean) / std])
            t, event = batch[TIME].to_numpy(float), batch[EVENT].to_numpy(float)
            sigma = math.exp(theta[-1])
            z = (np.log(t) - x @ theta[:-1]) / sigma
            log_tail, hazard = _upper_tail(z)
            density = -z * z / 2 - math.log(math.sqrt(2 * math.pi)) - theta[-1] - np.log(t)
            first = np.where(event > 0, -z, -hazard)
            second = np.where(event > 0, -1.0, -hazard * (hazard - z))
            gradient = np.append(x.T @ (-first / sigma), np.sum(-z * first - event))
            hessian = np.zeros((p, p))
            hessian[:-1, :-1] = (x * (second / sigma**2)[:, None]).T @ x
            hessian[:-1, -1] = hessian[-1, :-1] = x.T @ ((z * second + first) / sigma)
            hessian[-1, -1] = np.sum(z * first + z * z * second)
            total += np.concatenate([[np.sum(np.where(event > 0, density, log_tail))], gradient, hessian.ravel()])
        yield pd.DataFrame({"k": np.arange(total.size, dtype=np.int32), "v": total})

    total = _collect_sums(frame.select(*features, TIME, EVENT), reduce_batches, 1 + p + p * p)
    return total[0], total[1 : 1 + p], total[1 + p :].reshape(p, p)


def _newton(evaluate, start: np.ndarray, penalty: np.ndarray, n: int, steps: int, tolerance: float):
    """Maximise mean log-likelihood minus half the ridge; halve a step that loses ground.

    A step that never gains leaves the point as it is.
    """
    theta, trace = start, []
    value, gradient, hessian = evaluate(theta)
    objective = value / n - 0.5 * np.sum(penalty * theta**2)
    if not np.isfinite(objective):
        raise ValueError("the likelihood is not a number at the start")
    for _ in range(steps):
        slope = gradient / n - penalty * theta
        curve = hessian / n - np.diag(penalty)
        if not (np.isfinite(slope).all() and np.isfinite(curve).all()):
            raise ValueError("the likelihood has derivatives that are not numbers")
        trace.append(objective)
        move = slope
        for ridge in (0.0, *(10.0**k for k in range(-3, 9))):
            newton = np.linalg.solve(curve - ridge * np.eye(len(theta)), -slope)
            if slope @ newton > 0:
                move = newton
                break
        gain, size = 0.0, 1.0
        while size > 1e-6:
            trial = theta + size * move
            tried = evaluate(trial)
            reached = tried[0] / n - 0.5 * np.sum(penalty * trial**2)
            if np.isfinite(reached) and reached >= objective - 1e-12:
                gain = reached - objective
                theta, (value, gradient, hessian), objective = trial, tried, reached
                break
            size /= 2
        if gain <= tolerance * (1 + abs(objective)):
            break
    else:
        raise RuntimeError(f"the fit still gains after {steps} steps; allow more")
    slope = gradient / n - penalty * theta
    return theta, value, float(np.max(np.abs(slope))), trace


def fit_aft(train: DataFrame, features: list[str], ridge: float = 0.05, steps: int = 40, tolerance: float = 1e-10) -> AftModel:
    """Log-normal AFT; the ridge is on the standardised coefficients, never on intercept or scale."""
    rows = cut_lineage(train.select(*[F.col(c).cast("double").alias(c) for c in features], TIME, EVENT))
    mean, std, n = scale(rows, features)
    spread = rows.agg(F.avg(F.log(TIME)).alias("m"), F.stddev_samp(F.log(TIME)).alias("s")).first()
    start = np.zeros(len(features) + 2)
    start[0], start[-1] = spread["m"], math.log(max(spread["s"] or 1.0, 1e-2))
    penalty = np.array([0.0, *[ridge] * len(features), 0.0])
    theta, value, slope, trace = _newton(
        lambda th: aft_sums(rows, features, mean, std, th), start, penalty, n, steps, tolerance
    )
    b = theta[1:-1] / std
    return AftModel(features, [float(v) for v in b], float(theta[0] - b @ mean), float(math.exp(theta[-1])), float(value), slope, trace)


def _prefixed(days: DataFrame, columns: list[str], later: bool) -> DataFrame:
    """``days`` with each column summed over all earlier (or later) days, the day itself included.

    Days are summed inside their block; a block's total is carried into those behind it
    over one row per block.
    """
    order = F.col("t").desc() if later else F.col("t")
    inside = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(F.col("block").desc() if later else F.col("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = days.groupBy("block").agg(*[F.sum(c).alias(c) for c in columns])
    carried = totals.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"carried_{c}") for c in columns])
    summed = [(F.sum(c).over(inside) + F.col(f"carried_{c}")).alias(f"{c}_to") for c in columns]
    return days.join(carried, "block").select(*days.columns, *summed)


def _risk_by_day(rows: DataFrame, xs: list[str], beta: np.ndarray) -> DataFrame:
    """``block, t, deaths, s0, s1_j``: what a day's rows add to the risk sets, one block of days per task."""
    sums = ["deaths", "s0", *[f"s1_{x}" for x in xs]]

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        days, total = np.zeros(0), np.zeros((0, len(sums)))
        for batch in batches:
            x = batch[xs].to_numpy(float)
            risk = np.exp(x @ beta)
            days = np.concatenate((days, batch[TIME].to_numpy(float)))
            total = np.concatenate((total, np.column_stack([batch[EVENT].to_numpy(float), risk, x * risk[:, None]])))
            order = np.argsort(days, kind="stable")
            days, total = days[order], total[order]
            first = np.flatnonzero(np.diff(days, prepend=np.nan) != 0)
            days, total = days[first], np.add.reduceat(total, first) if len(first) else total
        yield pd.DataFrame({"block": np.floor(days / BLOCK_DAYS).astype(np.int64), "t": days} | dict(zip(sums, total.T)))

    made = rows.mapInPandas(reduce_batches, "block long, t double, " + ", ".join(f"{c} double" for c in sums))
    return made.repartition("block").groupBy("block", "t").agg(*[F.sum(c).alias(c) for c in sums])


def cox_sums(rows: DataFrame, xs: list[str], beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Partial log-likelihood with tied days taken together, its gradient and Hessian.

    Risk sets are suffix sums over days.  With the cumulative hazard H(t) = sum of deaths / s0
    up to t, the second sums over risk sets become one sum over rows weighted by risk x H,
    less one over days of the risk set's mean: both have the form sum of w x x', so one
    reducer takes rows and days together and only 1 + d + d^2 numbers reach the driver.
    """
    d, s1 = len(xs), [f"s1_{x}" for x in xs]
    days = _prefixed(_risk_by_day(rows, xs, beta), ["s0", *s1], later=True)
    days = days.withColumn("h", F.col("deaths") / F.col("s0_to"))
    hazard = _prefixed(days.select("block", "t", "h"), ["h"], later=False).select(F.col("t").alias(TIME), F.col("h_to").alias("hazard"))
    none = F.lit(None).cast("double")
    at_rows = rows.join(hazard, TIME).select(*xs, F.col(EVENT).cast("double").alias("event"), "hazard", none.alias("deaths"), none.alias("s0"))
    at_days = days.filter("deaths > 0").select(*[(F.col(f"{s}_to") / F.col("s0_to")).alias(x) for s, x in zip(s1, xs)],
                                               none.alias("event"), none.alias("hazard"), "deaths", F.col("s0_to").alias("s0"))

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + d + d * d)
        for batch in batches:
            x = batch[xs].to_numpy(float)
            event, hazard, deaths, s0 = batch[["event", "hazard", "deaths", "s0"]].to_numpy(float).T
            row = np.isnan(deaths)
            eta = x @ beta
            weight = np.where(row, np.exp(np.where(row, eta, 0)) * hazard, -deaths)
            value = np.where(row, event * eta, -deaths * np.log(np.where(row, 1, s0)))
            slope = np.where(row, event - weight, 0)
            total += np.concatenate([[value.sum()], x.T @ slope, ((x * weight[:, None]).T @ x).ravel()])
        yield pd.DataFrame({"k": np.arange(total.size, dtype=np.int32), "v": total})

    total = _collect_sums(at_rows.unionByName(at_days), reduce_batches, 1 + d + d * d)
    return total[0], total[1 : 1 + d], -total[1 + d :].reshape(d, d)


def standardised(train: DataFrame, features: list[str]) -> tuple[DataFrame, list[str], np.ndarray, int]:
    """``x0, x1, ...`` with mean 0 and deviation 1 beside time and event, the deviations and the row count."""
    plain = train.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(TIME).cast("double").alias(TIME), EVENT)
    mean, std, n = scale(plain, features)
    xs = [f"x{i}" for i in range(len(features))]
    return plain.select(*[((F.col(c) - float(m)) / float(s)).alias(x) for c, x, m, s in zip(features, xs, mean, std)], TIME, EVENT), xs, std, n


def fit_cox(train: DataFrame, features: list[str], ridge: float = 0.1, steps: int = 40, tolerance: float = 1e-10) -> CoxModel:
    """Cause-specific proportional hazards; every ending but a stockout is censoring."""
    rows, xs, std, n = standardised(cut_lineage(train.select(*features, TIME, EVENT)), features)
    beta, value, slope, _ = _newton(lambda th: cox_sums(rows, xs, th), np.zeros(len(features)), np.full(len(features), ridge), n, steps, tolerance)
    return CoxModel(features, [float(v) for v in beta / std], float(value), slope)


def weibull_aft(train: DataFrame, features: list[str]):
    """The published comparator, as the built-in accelerated failure time regression."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression

    assembled = VectorAssembler(inputCols=features, outputCol="x").transform(
        train.select(*[F.col(c).cast("double").alias(c) for c in features], TIME, F.col(EVENT).cast("double").alias("observed"))
    )
    return AFTSurvivalRegression(featuresCol="x", labelCol=TIME, censorCol="observed").fit(assembled)
