"""Sampling weights, deterministic weighted samples, length-bucketed batches, and losses over predictions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import bce_with_logits, smooth_l1, softplus


def task_entity_weights(obs: DataFrame, task: str = "task", entity: str = "entity") -> DataFrame:
    """weight = 1 / (observations of the entity in the task * entities of the task)."""
    per = obs.groupBy(task, entity).agg(F.count("*").alias("_k"))
    tasks = per.groupBy(task).agg(F.count("*").alias("_e"))
    return obs.join(per, [task, entity]).join(tasks, task).withColumn("weight", 1 / (F.col("_k") * F.col("_e"))).drop("_k", "_e")


def source_weights(obs: DataFrame, source: str = "endpoint", entity: str = "entity", sources: int = 3) -> DataFrame:
    """As task weights, every source with a mass of 1 / sources."""
    return task_entity_weights(obs, source, entity).withColumn("weight", F.col("weight") / sources)


def class_entity_weights(obs: DataFrame, label: str = "label", entity: str = "entity") -> DataFrame:
    """An entity's mass is shared by its observations, and classes have equal masses."""
    per = obs.groupBy(entity).agg(F.count("*").alias("_k"))
    j = obs.join(per, entity).withColumn("_m", 1 / F.col("_k"))
    mass = j.groupBy(label).agg(F.sum("_m").alias("_c"))
    return j.join(mass, label).withColumn("weight", F.col("_m") / F.col("_c")).drop("_k", "_m", "_c")


def inverse_class_weights(obs: DataFrame, label: str = "label") -> DataFrame:
    c = obs.groupBy(label).agg(F.count("*").alias("_k"))
    return obs.join(c, label).withColumn("weight", 1 / F.col("_k")).drop("_k")


def drawn(*parts) -> Column:
    """52 bits that depend on the parts only: the first 13 hexadecimal digits of the md5 of them joined by ':'."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *cols) -> Column:
    """A reproducible number in (0, 1) for each row."""
    return (drawn(seed, *[F.col(c) if isinstance(c, str) else c for c in cols]) + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, by the smallest -log(u) / weight (a distributed top-n)."""
    return df.withColumn("_o", -F.log(uniform(seed, key)) / F.col(weight)).orderBy("_o", key).limit(n).drop("_o")


def poisson_resample(df: DataFrame, weight: str, n: int, seed: int, key: str) -> DataFrame:
    """Rows with replacement: each as often as a Poisson count of mean n * weight / total says."""
    total = df.agg(F.sum(weight).alias("_t"))
    mean = F.col(weight) / F.col("_t") * n
    j = df.crossJoin(F.broadcast(total)).withColumn("_u", uniform(seed, key))  # one row
    # inverse of the distribution function, up to 30
    start = F.struct(F.exp(-mean).alias("t"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(a, i):
        t = a["t"] * mean / i
        return F.struct(t.alias("t"), (a["c"] + t).alias("c"), (a["k"] + F.when(F.col("_u") > a["c"], 1).otherwise(0)).alias("k"))

    count = F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, step, lambda a: a["k"])
    return j.withColumn("draw", F.explode(F.sequence(F.lit(0), count))).where("draw > 0").drop("_t", "_u")


def length_batches(df: DataFrame, length: str, size: int, pool: int, seed: int, key: str, shards: int = 64) -> DataFrame:
    """(shard, batch): rows in a random order by shard, pools of `pool` batches sorted by length and cut."""
    from pyspark.sql import Window as W

    s = df.withColumns({"shard": F.pmod(drawn(seed, "shard", F.col(key)), F.lit(shards)).cast("int"), "_u": uniform(seed, key)})
    s = s.withColumn("_pool", F.floor((F.row_number().over(W.partitionBy("shard").orderBy("_u", key)) - 1) / (size * pool)))
    r = F.row_number().over(W.partitionBy("shard", "_pool").orderBy(length, key)) - 1
    return s.withColumn("batch", F.col("_pool") * pool + F.floor(r / size)).drop("_u", "_pool")


def budget_batches(df: DataFrame, key: str, length: str, budget: int, extra: int = 2, shards: int = 64) -> DataFrame:
    """(key, length, shard, batch): in each shard, by length, a batch grows while (longest + extra) * rows
    stays within the budget. The fold streams over sorted rows of a partition."""
    d = df.select(key, length).withColumn("shard", F.pmod(drawn("shard", F.col(key)), F.lit(shards)).cast("int"))
    d = d.repartition(shards, "shard").sortWithinPartitions("shard", length, key)

    def run(batches):
        shard = None
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            for k, (s, n) in enumerate(zip(pdf["shard"], pdf[length])):
                if s != shard:
                    shard, batch, rows = s, 0, 0
                elif (n + extra) * (rows + 1) > budget:
                    batch, rows = batch + 1, 0
                rows += 1
                out[k] = batch
            yield pdf.assign(batch=out)

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    return d.mapInPandas(run, f"{key} {kinds[key]}, {length} {kinds[length]}, shard int, batch long")


def multitask_loss(preds: DataFrame, task: str = "task", regression: str = "regression", beta: float = 1.0) -> DataFrame:
    """Mean over tasks of their mean losses: Huber for the regression task, log loss otherwise."""
    l = F.when(F.col(task) == regression, smooth_l1(F.col("score"), F.col("target"), beta)).otherwise(bce_with_logits(F.col("score"), F.col("target")))
    return preds.groupBy(task).agg(F.avg(l).alias("loss")).agg(F.avg("loss").alias("loss"))


CELL, NODES, FLAT = 0.5, 10, 40.0
_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_SPREAD = np.polynomial.chebyshev.chebvander(_AT, NODES - 1).T * np.where(np.arange(NODES), 2, 1)[:, None] / NODES


def _nodes(v: np.ndarray, w: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The weight that each value lays on the Chebyshev nodes of its cell."""
    return np.polynomial.chebyshev.chebvander(2 * (v / CELL - cell) - 1, NODES - 1) @ _SPREAD * w[:, None]


def _pairs_over(p: np.ndarray, wp: np.ndarray, n: np.ndarray, wn: np.ndarray, t: float) -> int:
    """The weight of the pairs with n - t >= p. Values are sorted."""
    upto = np.concatenate([[0], np.cumsum(wn)])
    return int(wp @ (upto[-1] - upto[np.searchsorted(n - t, p)]))


def _softplus_over(p: np.ndarray, wp: np.ndarray, n: np.ndarray, wn: np.ndarray, t: float) -> float:
    """The sum of softplus(n - p) over the same pairs, without forming them: both sides fall in cells, n
    moved by t. Pairs of one cell are cut value by value; those of a higher cell of n are whole, and softplus
    between two cells is its interpolation at their nodes (error under 1e-13), the difference itself beyond FLAT."""
    v = n - t
    cp, cn = np.floor(p / CELL), np.floor(v / CELL)
    mp, mn = _nodes(p, wp, cp), _nodes(v, wn, cn)
    upto = np.concatenate([np.zeros((1, NODES)), np.cumsum(mn, 0)])
    total = 0.0
    for i in range(0, len(p), 1 << 16):
        own, c = p[i : i + (1 << 16)], cp[i : i + (1 << 16)]
        rest = upto[np.searchsorted(cn, c, "right")] - upto[np.searchsorted(v, own)]
        at = (c[:, None] + (_AT + 1) / 2) * CELL
        total += float(wp[i : i + (1 << 16)] @ (rest * np.logaddexp(0, t + at - own[:, None])).sum(1))
    (kp, sp), (kn, sn) = np.unique(cp, return_index=True), np.unique(cn, return_index=True)
    mp, mn = np.add.reduceat(mp, sp), np.add.reduceat(mn, sn)
    last = math.ceil((FLAT - t) / CELL) + 1
    for o in range(max(1, math.floor((-FLAT - t) / CELL) - 1), min(last, int(kn[-1] - kp[0])) + 1):
        at = np.minimum(np.searchsorted(kn, kp + o), len(kn) - 1)
        hit = np.flatnonzero(kn[at] == kp + o)
        between = np.logaddexp(0, t + CELL * (o + (_AT[None, :] - _AT[:, None]) / 2))
        total += float(np.sum((mp[hit] @ between) * mn[at[hit]]))
    far = np.searchsorted(kn, kp + max(last, 0), "right")
    w, m = (np.concatenate([np.cumsum(np.add.reduceat(x, sn)[::-1])[::-1], [0]])[far] for x in (wn, wn * n))
    return total + float(np.add.reduceat(wp, sp) @ m - np.add.reduceat(wp * p, sp) @ w)


def hardest_mean(p: np.ndarray, wp: np.ndarray, n: np.ndarray, wn: np.ndarray, k: int) -> float:
    """The mean of softplus(n - p) over the k pairs of largest n - p, of sorted finite values that stand for wp
    and wn rows. The least of these differences is found by bisection on counts, so time grows with n log n."""
    slack = 1e-9 * (1 + abs(n[0]) + abs(n[-1]) + abs(p[0]) + abs(p[-1]))
    low, high = n[0] - p[-1] - slack, n[-1] - p[0] + slack
    if k >= int(wp.sum()) * int(wn.sum()):
        return _softplus_over(p, wp, n, wn, low) / k
    while low < (mid := (low + high) / 2) < high and high - low > 1e-6 * slack:
        low, high = (mid, high) if _pairs_over(p, wp, n, wn, mid) >= k else (low, mid)
    return (_softplus_over(p, wp, n, wn, high) + (k - _pairs_over(p, wp, n, wn, high)) * float(np.logaddexp(0, low))) / k


def binary_rank_loss(preds: DataFrame, by: list[str], temperature: float = 1.0, hard: float = 1.0, margin: float = 0.0) -> DataFrame:
    """Mean softplus of margin less the score gap over positive-negative pairs of a batch, or over the
    hardest share of them. by names the batch. Pairs are counted and summed, not formed: a batch is its
    distinct scores with their numbers of positives and negatives, which one task holds.

    Defined cases, as in SQL: a pair with a null score counts in the share, is the least hard and has no loss;
    NaN is the hardest; a batch without pairs, or of a null key, has loss 0."""
    if temperature <= 0 or not 0 < hard <= 1:
        raise ValueError("temperature must be positive and hard in (0, 1]")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    s = preds.groupBy(*by, F.col("score").cast("double").alias("_s")).agg(count(F.col("target") > 0.5)("_p"), count(F.col("target") <= 0.5)("_q"))

    def run(key, rows):
        s, p, q = (rows.column(c).to_numpy() for c in ("_s", "_p", "_q"))
        live = rows.column("_s").is_valid().to_numpy()
        every = int(p.sum()) * int(q.sum())
        k = min(max(math.ceil(every * hard), 1), int(p[live].sum()) * int(q[live].sum()))
        if any(x.as_py() is None for x in key):
            k = 0
        loss = _share(s[live], p[live], q[live], k) if k else 0.0
        out = rows.select(by).slice(0, 1)
        return out.append_column("loss", pa.array([loss], pa.float64())).append_column("pairs", pa.array([k], pa.int64()))

    def _share(s, p, q, k):
        """The mean loss of the k hardest pairs. Differences that are not finite make losses of NaN, infinity or 0."""
        odd = [(x, y, int(a) * int(b)) for here, there in ((~np.isfinite(s), np.ones(len(s), bool)), (np.isfinite(s), ~np.isfinite(s))) for x, a in zip(s[here], p[here]) if a for y, b in zip(s[there], q[there]) if b]
        gaps = [(float(y) - float(x), c) for x, y, c in odd]
        if any(math.isnan(g) for g, _ in gaps):
            return math.nan
        if any(g > 0 for g, _ in gaps):
            return math.inf
        s, p, q = (x[np.isfinite(s)] for x in (s, p, q))
        o = np.argsort(s)
        s, p, q = s[o], p[o], q[o]
        take = min(k, int(p.sum()) * int(q.sum()))
        a, b = p > 0, q > 0
        return hardest_mean(s[a] / temperature, p[a], (s[b] + margin) / temperature, q[b], take) * temperature * take / k if take else 0.0

    from pyspark.sql.types import DoubleType, LongType, StructType

    kinds = StructType([preds.schema[c] for c in by]).add("loss", DoubleType()).add("pairs", LongType())
    return s.groupBy(*by).applyInArrow(run, kinds)


def regression_rank_loss(preds: DataFrame, by: list[str], key: str, gap: float = 0.02) -> DataFrame:
    """Mean softplus of the negative signed score gap over pairs of a batch whose targets differ by more than gap."""
    a = preds.select(*by, F.col(key).alias("ka"), F.col("target").alias("ta"), F.col("score").alias("sa"))
    b = preds.select(*by, F.col(key).alias("kb"), F.col("target").alias("tb"), F.col("score").alias("sb"))
    j = a.join(b, by).where((F.col("ka") < F.col("kb")) & (F.abs(F.col("ta") - F.col("tb")) > gap))
    return j.groupBy(*by).agg(F.avg(softplus(-F.signum(F.col("ta") - F.col("tb")) * (F.col("sa") - F.col("sb")))).alias("loss"), F.count("*").alias("pairs"))


def bootstrap(df: DataFrame, value: str, key: str, rounds: int = 200, seed: int = 1) -> DataFrame:
    """(low, mean, high): the central 95% of means under Poisson resampling, all rounds in one pass."""
    u = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: uniform(seed, key, r))
    cuts, p, c = [], float(np.exp(-1)), 0.0
    for k in range(8):
        c += p
        cuts.append(c)
        p /= k + 1
    times = lambda x: sum((F.when(x > t, 1).otherwise(0) for t in cuts), F.lit(0))
    e = df.select(F.col(value).alias("v"), F.posexplode(F.transform(u, times)).alias("round", "w")).where("w > 0")
    means = e.groupBy("round").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.avg("m").alias("mean"), F.percentile("m", 0.975).alias("high"))


