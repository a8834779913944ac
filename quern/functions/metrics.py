"""Exact ranking, classification and regression metrics as grouped aggregates.

Every function takes the grouping columns first (an empty list for one row over all). Ranking metrics
aggregate to distinct scores before any ordering, and order in buckets (operators.prefix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import running_sums


def _grid(df: DataFrame, by: list[str], target: str, score: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(w * F.col(target)).alias("p"), F.sum(w * (1 - F.col(target))).alias("n"))


def corr(x: str, y: str):
    """Pearson's correlation; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def auroc(df, by, target="target", score="score", weight=None, parts=32) -> DataFrame:
    """Share of positive-negative pairs in order, ties half; null without pairs."""
    g = running_sums(_grid(df, by, target, score, weight), by, "s", {"cn": "n"}, parts=parts)
    return g.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("cn") - F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc"))


def average_precision(df, by, target="target", score="score", weight=None, parts=32) -> DataFrame:
    """Sum of recall steps times precision over distinct thresholds."""
    g = running_sums(_grid(df, by, target, score, weight), by, "s", {"tp": "p", "fp": "n"}, descending=True, parts=parts)
    return g.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("p")).alias("auprc"))


def confusion(df, by, target="target", score="score", threshold=0.5, weight=None) -> DataFrame:
    """tp, fp, fn, tn and mcc, f1, balanced_accuracy at score >= threshold; mcc is 0 without a denominator."""
    w = F.col(weight) if weight else F.lit(1.0)
    hit, pos = F.col(score) >= threshold, F.col(target) == 1
    part = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    c = df.groupBy(*by).agg(part(hit & pos).alias("tp"), part(hit & ~pos).alias("fp"), part(~hit & pos).alias("fn"), part(~hit & ~pos).alias("tn"))
    return c.withColumns(rates())


def rates() -> dict:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "mcc": F.when(root > 0, (tp * tn - fp * fn) / F.when(root > 0, root)).otherwise(0.0),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "balanced_accuracy": (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2,
    }


def brier(df, by, target="target", score="score", weight=None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*by).agg((F.sum(w * F.pow(F.col(score) - F.col(target), 2)) / F.sum(w)).alias("brier"))


def ece(df, by, target="target", score="score", bins=10, weight=None) -> DataFrame:
    """Mass-weighted gap between mean score and mean target over equal bins, the last closed. The edges are
    k / bins in floating point, as an evenly spaced grid has them."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = F.col(score)
    b = sum((F.when(s >= k / bins, 1).otherwise(0) for k in range(1, bins)), F.lit(0))
    g = df.groupBy(*by, b.alias("bin")).agg(F.sum(w).alias("m"), F.sum(w * s).alias("ps"), F.sum(w * F.col(target)).alias("ts"))
    return g.groupBy(*by).agg((F.sum(F.abs(F.col("ps") - F.col("ts"))) / F.sum("m")).alias("ece"))


def mid_ranks(df, by, cols: list[str], parts=32) -> DataFrame:
    """df with rank_<col>: the mean rank of equal values, from 1."""
    for c in cols:
        g = running_sums(df.groupBy(*by, F.col(c).cast("double").alias("s")).agg(F.count("*").alias("k")), by, "s", {"ck": "k"}, parts=parts)
        g = g.select(*[F.col(x).alias(f"_g_{x}") for x in by], F.col("s").alias("_s"), (F.col("ck") - (F.col("k") - 1) / 2).alias(f"rank_{c}"))
        on = F.col("_s") == F.col(c).cast("double")
        for x in by:
            on = on & F.col(x).eqNullSafe(F.col(f"_g_{x}"))
        df = df.join(g, on).drop("_s", *[f"_g_{x}" for x in by])
    return df


def regression(df, by, target="target", score="score", parts=32) -> DataFrame:
    """n, pearson, spearman, rmse, mae."""
    r = mid_ranks(df, by, [target, score], parts)
    d = F.col(score) - F.col(target)
    return r.groupBy(*by).agg(
        F.count("*").alias("n"), corr(target, score).alias("pearson"), corr(f"rank_{target}", f"rank_{score}").alias("spearman"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
    )


def best_mcc(df, by, target="target", score="score", parts=32) -> DataFrame:
    """mcc and threshold: the best over all distinct scores as thresholds, the highest of equals."""
    g = _grid(df, by, target, score, None)
    g = running_sums(g, by, "s", {"tp": "p", "fp": "n"}, descending=True, parts=parts)
    total = g.groupBy(*by).agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    g = g.join(F.broadcast(total), by) if by else g.crossJoin(F.broadcast(total))  # a row for each group
    g = g.withColumns({"fn": F.col("pp") - F.col("tp"), "tn": F.col("nn") - F.col("fp")}).withColumns(rates())
    return g.groupBy(*by).agg(F.max(F.struct(F.round("mcc", 12).alias("r"), "s", "mcc")).alias("b")).select(*by, F.col("b.mcc").alias("mcc"), F.col("b.s").alias("threshold"))


def task_reports(df, entity: str, regression_tasks: list[str], task="task", target="target", score="score") -> DataFrame:
    """(task, auroc, auprc, spearman, rmse): entities weigh the same within a task. Binary tasks weight a
    row by one over its entity's rows; regression tasks take the entity's mean target and mean score."""
    is_regression = F.col(task).isin(regression_tasks)
    keys = [task, entity]
    b = df.where(~is_regression)
    b = b.join(b.groupBy(*keys).agg((1.0 / F.count("*")).alias("_w")), keys)
    r = df.where(is_regression).groupBy(*keys).agg(F.avg(target).alias(target), F.avg(score).alias(score))
    binary = auroc(b, [task], target, score, "_w").join(average_precision(b, [task], target, score, "_w"), task)
    other = regression(r, [task], target, score)
    none = F.lit(None).cast("double")
    return binary.select(task, "auroc", "auprc", none.alias("spearman"), none.alias("rmse")).union(other.select(task, none, none, "spearman", "rmse"))


def balanced(reports) -> DataFrame:
    """One row: the mean over tasks of 1 - auroc (binary) or 1 - spearman (regression); lower is better."""
    return reports.agg(F.avg(1 - F.coalesce("auroc", "spearman")).alias("balanced_objective"))
