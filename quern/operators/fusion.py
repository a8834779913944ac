"""Forward operators of fusion and message passing with given weights, as expressions and grouped aggregates.

Training of networks is out of scope; these are the deterministic parts that relational plans can hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def late(a: Column, b: Column, share: float) -> Column:
    return a * (1 - share) + b * share


def gated_residual(a: Column, b: Column, gate: Column) -> Column:
    """a plus b through a sigmoid gate; a closed gate leaves a."""
    return a + b / (1 + F.exp(-gate))


def film(a: Column, gamma: Column, beta: Column) -> Column:
    """Feature-wise scale and shift, the identity at gamma = beta = 0."""
    return a * (1 + gamma) + beta


def monotone_head(z: Column, raw_slope: float, shift: float) -> Column:
    """Strictly increasing in z: the slope is softplus(raw) + 1e-4."""
    return z * (math.log1p(math.exp(raw_slope)) + 1e-4) + shift


def layer_norm(df: DataFrame, by: list[str], col: str, eps: float = 1e-5, name: str = "normed") -> DataFrame:
    w = W.partitionBy(*by)
    return df.withColumn(name, (F.col(col) - F.avg(col).over(w)) / F.sqrt(F.pow(F.stddev_pop(col).over(w), 2) + eps))


def message_layer(nbrs: DataFrame, values: DataFrame, by: str, col: str, width: float = 4.0, confidence: str | None = None) -> DataFrame:
    """(by, pos, out): value plus tanh of the attention-weighted mean of the neighbours' values. The logit of
    a neighbour falls with the square of its distance; slots that repeat a neighbour or lie at distance 0
    are not valid, and a neighbour's confidence, where given, scales its weight. A position without a
    valid neighbour keeps its value."""
    v = values.select(by, F.col("pos").alias("j"), F.col(col).alias("_v"), (F.col(confidence) if confidence else F.lit(1.0)).alias("_c"))
    n = nbrs.where("dist > 0").groupBy(by, "i", "j").agg(F.min("dist").alias("dist")).join(v, [by, "j"])
    n = n.withColumn("_w", F.exp(-F.pow(F.col("dist") / width, 2)) * F.col("_c"))
    m = n.groupBy(by, F.col("i").alias("pos")).agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("_m"))
    return values.join(m, [by, "pos"], "left").select(by, "pos", (F.col(col) + F.tanh(F.coalesce("_m", F.lit(0.0)))).alias("out"))


def confidence_gate(df: DataFrame, by: list[str], col: str, confidence: str, floor: float = 1e-6) -> DataFrame:
    """Confidence-weighted mean of each group."""
    return df.groupBy(*by).agg((F.sum(F.col(col) * F.col(confidence)) / F.greatest(F.sum(confidence), F.lit(floor))).alias("pooled"))
