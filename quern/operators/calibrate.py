"""Calibration of scores: temperature, Platt, beta, isotonic, affine; folds and thresholds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.scalar import bce_with_logits, logit, softplus


def nll_grid(df: DataFrame, temperatures: list[float], by: list[str] | None = None, target: str = "target", score: str = "score") -> DataFrame:
    """(temperature, nll) over a fixed grid, in one pass over the rows."""
    by = by or []
    loss = F.array(*[bce_with_logits(F.col(score) / t, F.col(target)) for t in temperatures])
    e = df.select(*by, F.posexplode(loss).alias("k", "l")).groupBy(*by, "k").agg(F.avg("l").alias("nll"))
    t = F.array(*[F.lit(float(t)) for t in temperatures])
    return e.select(*by, t[F.col("k")].alias("temperature"), "nll")


def fit_temperature(df: DataFrame, low: float = -3.0, high: float = 3.0, target: str = "target", score: str = "score") -> float:
    """The temperature of least loss, its logarithm in [low, high]: grids of 33, each around the last's best."""
    for _ in range(6):
        logs = np.linspace(low, high, 33)
        row = nll_grid(df, np.exp(logs).tolist(), None, target, score).orderBy("nll", "temperature").first()
        at, step = math.log(row["temperature"]), logs[1] - logs[0]
        low, high = max(low, at - step), min(high, at + step)
    return math.exp(at)


def _newton(df: DataFrame, terms: list[Column], target: Column, start: list[float], rounds: int = 30, ridge: float = 1e-9, bounds=None) -> np.ndarray:
    """Logistic coefficients by damped Newton steps within bounds; each step is one aggregate of gradient and Hessian."""
    w = np.array(start, float)
    x = df.select(*[t.alias(f"x{k}") for k, t in enumerate(terms)], target.alias("y")).cache()
    n = len(terms)
    for _ in range(rounds):
        z = sum((F.lit(float(a)) * F.col(f"x{k}") for k, a in enumerate(w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
        row = x.agg(F.count("*"), *[F.sum((p - F.col("y")) * F.col(f"x{k}")) for k in range(n)], *[F.sum(p * (1 - p) * F.col(f"x{a}") * F.col(f"x{b}")) for a in range(n) for b in range(n)]).first()
        g, h = np.array(row[1 : 1 + n]) / row[0], np.array(row[1 + n :]).reshape(n, n) / row[0]
        step = np.linalg.solve(h + ridge * np.eye(n), g)
        new = w - np.clip(step, -2, 2)
        if bounds is not None:
            new = np.clip(new, *bounds)
        if np.abs(new - w).max() < 1e-9:
            w = new
            break
        w = new
    x.unpersist()
    return w


def fit_platt(df: DataFrame, target: str = "target", score: str = "score") -> tuple[float, float]:
    """(slope, shift): slope in [exp(-4), exp(4)], shift in [-5, 5]."""
    a, b = _newton(df, [F.col(score).cast("double"), F.lit(1.0)], F.col(target), [1.0, 0.0], bounds=([math.exp(-4), -5.0], [math.exp(4), 5.0]))
    return float(a), float(b)


def beta_logit(x: Column, a: float, b: float, c: float) -> Column:
    """a * log p - b * log(1 - p) + c of p = sigmoid(x): strictly increasing for a, b > 0."""
    return F.lit(c) - a * softplus(-x) + b * softplus(x)


def fit_beta(df: DataFrame, target: str = "target", score: str = "score") -> tuple[float, float, float]:
    x = F.col(score).cast("double")
    a, b, c = _newton(df, [-softplus(-x), softplus(x), F.lit(1.0)], F.col(target), [1.0, 1.0, 0.0], bounds=([1e-4, 1e-4, -20.0], [50.0, 50.0, 20.0]))
    return float(a), float(b), float(c)


def fit_isotonic(df: DataFrame, target: str = "target", score: str = "score") -> tuple[list[float], list[float]]:
    """Knots (score, value) of the non-decreasing fit; distinct scores are aggregated first."""
    g = df.groupBy(F.col(score).cast("double").alias("x")).agg(F.avg(target).alias("label"), F.count("*").cast("double").alias("w"))
    m = IsotonicRegression(featuresCol="f", labelCol="label", weightCol="w").fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(g))
    return m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()


def apply_isotonic(x: Column, knots: list[float], values: list[float]) -> Column:
    """Linear between knots, clipped beyond them; as a clipped logit with `logit`."""
    k, v = (F.array(*map(F.lit, c)) for c in (knots, values))
    n = F.aggregate(k, F.lit(0), lambda s, b: s + F.when(b <= x, 1).otherwise(0))
    low, high = F.greatest(n - 1, F.lit(0)), F.least(n, F.lit(len(knots) - 1))
    gap = k[high] - k[low]
    return F.when(gap > 0, v[low] + (v[high] - v[low]) * F.greatest(F.least((x - k[low]) / F.when(gap > 0, gap), F.lit(1.0)), F.lit(0.0))).otherwise(v[low])


def isotonic_logit(x: Column, knots: list[float], values: list[float]) -> Column:
    return logit(apply_isotonic(x, knots, values))


def folds(df: DataFrame, k: int = 5, seed: int = 20260830, idx: str = "entity_idx", target: str = "target") -> DataFrame:
    """fold: stratified by target, dealt in the order of a hash of the id."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(idx).cast("string")), 256)
    return df.withColumn("fold", F.pmod(F.row_number().over(W.partitionBy(target).orderBy(h)) - 1, F.lit(k)).cast("int"))


#: Method name to (fit over a frame, calibrated logit of a score by the fit).
METHODS = {
    "platt": (fit_platt, lambda x, p: p[0] * x + p[1]),
    "beta": (fit_beta, lambda x, p: beta_logit(x, *p)),
    "isotonic": (fit_isotonic, lambda x, p: isotonic_logit(x, *p)),
}


def crossfit(df: DataFrame, method: str, k: int = 5, target: str = "target", score: str = "score") -> DataFrame:
    """df with fold and out_of_fold: each fold's scores by the fit of the others. Fits are a few numbers,
    isotonic ones a knot for each distinct value of the fit."""
    from quern.plans.scratch import Scratch

    fit, apply = METHODS[method]
    f = Scratch(df.sparkSession).write(folds(df, k, target=target), "folds")
    out = None
    for i in range(k):
        p = fit(f.where(F.col("fold") != i), target, score)
        out = F.when(F.col("fold") == i, apply(F.col(score), p)) if out is None else out.when(F.col("fold") == i, apply(F.col(score), p))
    return f.withColumn("out_of_fold", out)


def crossfit_platt(df: DataFrame, k: int = 5, target: str = "target", score: str = "score") -> DataFrame:
    return crossfit(df, "platt", k, target, score)


def quantile_threshold_mcc(df: DataFrame, n: int = 2001, target: str = "target", score: str = "score") -> DataFrame:
    """(threshold, mcc): the best of n quantiles of the score as thresholds, the lowest of equals. Ranks of the
    thresholds come from sums over the sorted grid, not from a product with the rows."""
    from quern.functions.metrics import rates

    cuts = sorted(set(df.agg(F.percentile(score, [k / (n - 1) for k in range(n)])).first()[0]))
    c = F.array(*map(F.lit, cuts))
    upto = F.size(F.filter(c, lambda t: t <= F.col(score)))
    g = df.groupBy(upto.alias("k")).agg(F.sum(target).alias("p"), F.sum(1 - F.col(target)).alias("q"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(k + 1, t) for k, t in enumerate(cuts)], "k int, threshold double").join(g, "k", "left").fillna(0, ["p", "q"])
    w = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)  # n rows
    grid = grid.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("q").over(w)})
    total = df.agg(F.sum(target).alias("pp"), F.sum(1 - F.col(target)).alias("nn"))
    grid = grid.crossJoin(total).withColumns({"fn": F.col("pp") - F.col("tp"), "tn": F.col("nn") - F.col("fp")}).withColumns(rates())
    return grid.orderBy(F.desc(F.round("mcc", 12)), "threshold").limit(1).select("threshold", "mcc")


def affine(df: DataFrame, by: list[str], target: str = "target", score: str = "score") -> DataFrame:
    """slope and intercept of the least-squares line from score to target."""
    return df.groupBy(*by).agg(F.regr_slope(target, score).alias("slope"), F.regr_intercept(target, score).alias("intercept"))
