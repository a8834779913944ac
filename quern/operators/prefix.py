"""Prefix sums and dense numbering without a single-task sort.

Rows are bucketed by order-preserving cuts, ranked inside their bucket, and shifted by the totals of
the buckets before. The cuts need not be even for the result to be exact; they are few, so the totals
are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket_of(df: DataFrame, order: str, parts: int) -> Column:
    """Bucket number, growing with the (numeric) order column, by approximate quantiles."""
    cuts = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01))) if parts > 1 else []
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(order))) if cuts else F.lit(0)


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, str], descending: bool = False, parts: int = 32) -> DataFrame:
    """df, distinct in (by, order), with inclusive running sums: new column -> summed column."""
    b = df.withColumn("_b", bucket_of(df, order, parts))
    key = F.desc if descending else F.asc
    inside = W.partitionBy(*by, "_b").orderBy(key(order)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy(key("_b")).rowsBetween(W.unboundedPreceding, -1)
    totals = b.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = b.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(totals, [*by, "_b"])
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_b", *[f"_o_{n}" for n in sums])


def number_by_hash(df: DataFrame, key: str, name: str, digits: int = 3) -> DataFrame:
    """Zero-based dense numbers in the order of a hexadecimal key, its buckets the first digits."""
    b = df.withColumn("_b", F.substring(key, 1, digits))
    totals = b.groupBy("_b").agg(F.count("*").alias("_n"))
    totals = totals.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    # at most 16 ** digits rows
    out = b.join(F.broadcast(totals), "_b")
    rank = F.row_number().over(W.partitionBy("_b").orderBy(key))
    return out.withColumn(name, (F.col("_o") + rank - 1).cast("long")).drop("_b", "_o")
