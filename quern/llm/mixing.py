"""Mixing sources to target weights by temperature, in DataFrame functions only.

Weights are token shares to the power alpha, normalised. alpha is bisected to the smallest value (the
flattest mix) whose repetition stays within max_repetition, or to the one whose entropy meets
target_entropy. A source's tokens in the mix are weight * budget: whole passes over it, and for the
rest a prefix of its block permutation. Blocks are runs of the md5 of the id, in runs of blocks; sums of
both place the budget's end, and only the block that holds it is ranked row by row, so no source is ever
sorted in one task and no text is shuffled. Sources stay in a table: the exponent is bisected on their
extremes or, where their sum or entropy counts, by aggregates of a fan of exponents at a time.

Without budget_tokens the budget is the smallest at which every source is seen once in full: no
document is lost, and small sources repeat.

Defined cases: a null source is a source of its own; null and empty texts count no tokens and share
their source's passes; a source without any tokens passes once; rows that repeat an id are ranked by
their text's hash; an empty table gives an empty table; extra columns pass through whatever their
names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.plans.scratch import Scratch

BLOCK_ROWS = 1024
MAX_REPETITION = 2.0
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


FAN = 31  # exponents tried by one aggregate


def solve(totals: DataFrame, max_repetition: float | None, target_entropy: float | None, budget: int | None) -> tuple[float, float, float]:
    """(alpha, factor, largest total) of sources' tokens t: a source's share of the mix is factor * (t / largest) ** alpha tokens."""
    hi, lo = totals.agg(F.max("t"), F.min("t")).first()

    def sums(alphas):
        """Of (t / hi) ** alpha: the sum, and the sum of its products with its logarithm."""
        x = F.col("t") / F.lit(float(hi))
        got = totals.agg(*[c for a in alphas for c in (F.sum(F.pow(x, F.lit(a))), F.sum(F.pow(x, F.lit(a)) * F.log(x) * a))]).first()
        return [(got[2 * k], got[2 * k + 1]) for k in range(len(alphas))]

    def factor(alpha, total):
        # without a budget the largest source is seen once, and so the smallest most often
        return budget / total if budget else float(hi)

    def fits(alpha, total, logs):
        if target_entropy is not None:
            return math.log(total) - logs / total <= target_entropy
        return factor(alpha, total) * (lo / hi) ** alpha <= max_repetition * lo

    simple = target_entropy is None and not budget
    low, high = 0.0, 1.0
    for turn in range(81 if simple else 12):
        tried = [(low + high) / 2] if simple and turn else [low + (high - low) * k / (FAN + 1) for k in range(1, FAN + 1)] if turn else [low]
        ok = [a for a, (total, logs) in zip(tried, [(0, 0)] if simple else sums(tried)) if fits(a, total, logs)]
        if not turn:
            if ok:
                high = low
                break
            continue
        high = min(ok, default=high)
        low = max((a for a in tried if a < high), default=low)
    return high, factor(high, 1 if simple else sums([high])[0][0]), hi


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget_tokens: int | None = None, seed: str = "mix", details: bool = False) -> DataFrame:
    """docs with each row as often as its source's weight asks. details: also n_tokens, copy (from 1)
    and block (they replace columns so named)."""
    scratch = Scratch(docs.sparkSession)
    hexes = max(1, math.ceil(math.log(max(docs.count() / BLOCK_ROWS, 1), 16)))
    slim = docs.select(
        F.col(source_col).alias("s"), F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("m"),
        F.xxhash64(text_col).alias("x"), n_words(text_col).alias("t"),
    ).withColumn("b", F.substring("m", 1, hexes))
    blocks = scratch.write(slim.groupBy("s", "b").agg(F.sum("t").alias("t")).withColumn("c", F.substring("b", 1, hexes // 2)), "blocks")
    # running sums over runs of blocks, and over the blocks of a run
    runs = blocks.groupBy("s", "c").agg(F.sum("t").alias("r"))
    runs = runs.withColumn("upto", F.sum("r").over(W.partitionBy("s").orderBy("c").rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.select(F.col("s").alias("rs"), F.col("c").alias("rc"), (F.col("upto") - F.col("r")).alias("ahead"))
    blocks = blocks.withColumn("to", F.sum("t").over(W.partitionBy("s", "c").orderBy("b").rowsBetween(W.unboundedPreceding, 0)))
    blocks = blocks.join(runs, blocks["s"].eqNullSafe(F.col("rs")) & (F.col("c") == F.col("rc"))).select("s", "b", "t", (F.col("to") + F.col("ahead")).alias("to"))
    totals = scratch.write(blocks.groupBy("s").agg(F.sum("t").alias("t")), "totals")
    live = totals.where("t > 0")
    if live.isEmpty():
        alpha, factor, hi = 1.0, 0.0, 1
    else:
        alpha, factor, hi = solve(live, max_repetition, target_entropy, budget_tokens)
    want = F.floor(F.lit(float(factor)) * F.pow(F.col("t") / F.lit(float(hi)), F.lit(float(alpha))) + 0.5).cast("long")
    want = F.when(F.col("t") > 0, want)
    target = totals.select("s", F.coalesce(F.floor(want / F.col("t")).cast("long"), F.lit(1)).alias("whole"), F.coalesce(want % F.col("t"), F.lit(0)).alias("rest"))

    def with_target(df):
        t = target.select(F.col("s").alias("ts"), "whole", "rest")
        return df.join(t, df["s"].eqNullSafe(t["ts"])).drop("ts")

    edge = with_target(blocks).where("rest > to - t and rest <= to and rest > 0").select("s", "b", F.col("to").alias("to"), (F.col("to") - F.col("t")).alias("before"), "rest")
    edge = scratch.write(edge, "edges")  # a row for each source at most; joins of sources are left to their sizes
    e = edge.select(F.col("s").alias("es"), F.col("b").alias("eb"), "before", "rest")
    inside = slim.join(e, slim["s"].eqNullSafe(e["es"]) & (slim["b"] == e["eb"]))
    run = F.sum("t").over(W.partitionBy("s", "b").orderBy("m", "x").rangeBetween(W.unboundedPreceding, 0)) + F.col("before")
    last = inside.withColumn("run", run).where("run <= rest").groupBy("s").agg(F.max(F.struct("m", "x")).alias("last"))
    cut = scratch.write(edge.select(F.col("s").alias("cs"), F.col("b").alias("cb")).join(last, F.col("cs").eqNullSafe(F.col("s")), "left").select("cs", "cb", "last"), "cuts")
    rows = docs.select(
        F.struct("*").alias("row"), F.col(source_col).alias("s"), F.xxhash64(text_col).alias("x"),
        F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("m"),
    ).withColumn("b", F.substring("m", 1, hexes))
    rows = with_target(rows)
    rows = rows.join(cut, rows["s"].eqNullSafe(F.col("cs")), "left")
    extra = F.when(F.col("cb").isNull(), 0).when(F.col("b") < F.col("cb"), 1).when((F.col("b") == F.col("cb")) & (F.struct("m", "x") <= F.col("last")), 1).otherwise(0)
    rows = rows.withColumn("copies", F.col("whole") + extra).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    own = {"n_tokens": n_words("row." + text_col), "copy": F.col("copy"), "block": F.col("b")} if details else {}
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *[v.alias(k) for k, v in own.items()])


def op4_mixing(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs, details=True).select("doc_id", "source", "n_tokens", "copy")


ORACLE = r"""
WITH t AS (SELECT doc_id, source, text, md5('mix:' || doc_id::VARCHAR) AS m,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tok FROM t GROUP BY source),
g AS (SELECT max(tok) AS hi, min(tok) AS lo FROM s WHERE tok > 0),
e AS (SELECT CASE WHEN hi <= 2 * lo THEN 1.0 ELSE ln(2.0) / ln(hi / lo) END AS q, hi FROM g),
p AS (SELECT source, tok, CASE WHEN tok = 0 THEN 0 ELSE floor(tok * pow(hi / tok, q) + 0.5)::BIGINT END AS want FROM s, e),
r AS (SELECT t.*, p.tok, p.want, sum(n_tokens) OVER (PARTITION BY t.source ORDER BY m, doc_id) AS run FROM t JOIN p ON t.source = p.source),
c AS (SELECT doc_id, source, n_tokens, CASE WHEN tok = 0 THEN 1 ELSE want // tok + CASE WHEN run <= want % tok THEN 1 ELSE 0 END END AS copies FROM r)
SELECT doc_id, source, n_tokens, unnest(range(1, copies + 1)) AS copy FROM c
"""
