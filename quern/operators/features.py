"""Features over positions, neighbours and patches, and statistics that never see validation rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Residue sets of the surface-patch categories.
CATEGORIES = {
    "surface": "ACDEFGHIKLMNPQRSTVWY",
    "hydrophobic": "AVILMFWY",
    "positive": "KRH",
    "negative": "DE",
    "aromatic": "FWYH",
}


def train_only_standardise(df: DataFrame, cols: list[str], train: Column, floor: float = 1e-6, scale: float = 1.0, distinct_on: str | None = None) -> DataFrame:
    """z_<col>: (x - mean) / max(population deviation, floor) * scale with statistics of training rows only
    (of distinct entities, where distinct_on names them)."""
    part = df.where(train)
    part = part.dropDuplicates([distinct_on]) if distinct_on else part
    stats = part.agg(*[f for c in cols for f in (F.avg(c).alias(f"_m_{c}"), F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") * scale for c in cols}).drop(*stats.columns)


def array_moments(df: DataFrame, col: str, least: float = 1e-8) -> DataFrame:
    """(pos, n, mean, std) of every position of an array column; deviations under least count as 1."""
    e = df.select(F.posexplode(col).alias("pos", "x")).groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return e.withColumn("std", F.when(F.col("std") < least, 1.0).otherwise(F.col("std")))


def stats4(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.max(col).alias("max"), F.min(col).alias("min"))


def conditional_pool(df: DataFrame, by: list[str], col: str, keep: Column) -> DataFrame:
    """Mean and maximum over rows that qualify, over all rows of a group where none does."""
    x = F.when(keep, F.col(col))
    return df.groupBy(*by).agg(F.coalesce(F.avg(x), F.avg(col)).alias("mean"), F.coalesce(F.max(x), F.max(col)).alias("max"))


def chunked_mean(df: DataFrame, by: str, pos: str, col: str, size: int = 1022) -> DataFrame:
    """Exact mean through sums and counts of chunks of positions."""
    c = df.groupBy(by, F.floor(F.col(pos) / size).alias("chunk")).agg(F.sum(col).alias("s"), F.count(col).alias("k"))
    return c.groupBy(by).agg((F.sum("s") / F.sum("k")).alias("mean"), F.count("*").alias("chunks"))


def order(by: list[str], pos: str):
    return W.partitionBy(*by).orderBy(pos)


def shifts(df: DataFrame, by: list[str], pos: str, col: str, steps: list[int]) -> DataFrame:
    """before_<d> and after_<d>: the value d rows away, 0 beyond the ends."""
    w = order(by, pos)
    return df.withColumns({f"{n}_{d}": f(col, d, 0.0).over(w) for d in steps for n, f in (("before", F.lag), ("after", F.lead))})


def moving_average(df: DataFrame, by: list[str], pos: str, col: str, widths=(3, 7, 15)) -> DataFrame:
    return df.withColumns({f"avg_{k}": F.avg(col).over(order(by, pos).rowsBetween(-(k // 2), k // 2)) for k in widths})


def convolve(df: DataFrame, by: list[str], pos: str, col: str, kernel: list[float], name: str = "conv") -> DataFrame:
    w, half = order(by, pos), len(kernel) // 2
    terms = [F.lag(col, -d, 0.0).over(w) * k if d else F.col(col) * k for d, k in zip(range(-half, half + 1), kernel)]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def segments(df: DataFrame, by: list[str], pos: str, col: str, size: int = 32) -> DataFrame:
    return df.groupBy(*by, F.floor(F.col(pos) / size).alias("segment")).agg(F.avg(col).alias("mean"), F.max(col).alias("max"))


def softmax(df: DataFrame, by: list[str], col: str, name: str = "weight") -> DataFrame:
    w = W.partitionBy(*by)
    e = df.withColumn("_e", F.exp(F.col(col) - F.max(col).over(w)))
    return e.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_k_renormalised(df: DataFrame, by: list[str], col: str, k: int, tie: str) -> DataFrame:
    """The k largest of each group, as shares of their sum."""
    r = df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(col), tie))).where(F.col("_r") <= k)
    return r.withColumn("share", F.col(col) / F.sum(col).over(W.partitionBy(*by))).drop("_r")


def first_slots(df: DataFrame, by: list[str], neighbour: str, slot: str) -> DataFrame:
    """valid: false where a neighbour was seen in an earlier slot of its row."""
    return df.withColumn("valid", F.row_number().over(W.partitionBy(*by, neighbour).orderBy(slot)) == 1)


def neighbours(points: DataFrame, by: str, pos: str, coords: list[str], k: int = 16) -> DataFrame:
    """(by, i, rank, j, dist): the k nearest other positions within each entity, ties to the smaller position.
    A join on the entity only, so pairs never leave it."""
    a, b = points.alias("a"), points.alias("b")
    d = F.sqrt(sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in coords), F.lit(0.0)))
    pairs = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"a.{pos}") != F.col(f"b.{pos}"))).select(F.col(f"a.{by}").alias(by), F.col(f"a.{pos}").alias("i"), F.col(f"b.{pos}").alias("j"), d.alias("dist"))
    rank = F.row_number().over(W.partitionBy(by, "i").orderBy("dist", "j"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(by, "i", "rank", "j", "dist")


def gather(nbrs: DataFrame, values: DataFrame, by: str, pos: str, cols: list[str]) -> DataFrame:
    """Neighbours' values beside each neighbour row."""
    v = values.select(by, F.col(pos).alias("j"), *[F.col(c).alias(f"nbr_{c}") for c in cols])
    return nbrs.join(v, [by, "j"])


def separation(i: Column, j: Column, n: Column) -> list[Column]:
    """Signed share of the length, log share, and whether within four positions."""
    d = (j - i).cast("double")
    return [d / n, F.log1p(F.abs(d)) / F.log1p(n), F.abs(d) <= 4]


def invariants(vectors: Column, n: int) -> list[Column]:
    """Norms of n vectors, then the upper triangle of their inner products: n + n (n + 1) / 2 numbers."""
    from quern.functions.scalar import dot, norm

    v = [vectors[k] for k in range(n)]
    return [norm(x) for x in v] + [dot(v[a], v[b]) for a in range(n) for b in range(a, n)]


def knn(df: DataFrame, idx: str, vec: str, k: int = 3, block: int = 2048) -> DataFrame:
    """(i, rank, j, dist): exact Euclidean neighbours over the whole table, by pairs of packed blocks."""
    n = max(1, -(-df.count() // block))
    b = df.where(F.col(vec).isNotNull()).select(F.col(idx).cast("long").alias("x"), F.col(vec).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("x"), F.lit(n)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    left = b.select(F.col("b").alias("p"), F.explode(every).alias("q"), F.lit(0).alias("side"), "x", "v")
    right = b.select(F.explode(every).alias("p"), F.col("b").alias("q"), F.lit(1).alias("side"), "x", "v")

    def meet(pdf):
        l, r = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(l) or not len(r):
            return pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "dist": np.zeros(0)})
        a, c, ids = np.stack(l["v"]), np.stack(r["v"]), r["x"].to_numpy()
        out = []
        for i, x in zip(l["x"], a):
            d = np.sqrt(((c - x) ** 2).sum(1))
            d[ids == i] = np.inf
            o = np.lexsort((ids, d))[:k]
            o = o[np.isfinite(d[o])]
            out.append(pd.DataFrame({"i": i, "j": ids[o], "dist": d[o]}))
        return pd.concat(out)

    near = left.union(right).groupBy("p", "q").applyInPandas(meet, "i long, j long, dist double")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy("dist", "j"))).where(F.col("rank") <= k).select("i", "rank", "j", "dist")


def whole_groups(batches, by: str):
    """Frames of whole groups from batches that are sorted by the group: a batch's last group waits for the next."""
    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = pdf[by].ne(pdf[by].iloc[-1]).to_numpy().nonzero()[0]
        cut = new[-1] + 1 if len(new) else 0
        if cut or (held and held[-1][by].iloc[-1] != pdf[by].iloc[-1]):
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def patch_components(residues: DataFrame, by: str, rsa_least: float = 0.25, cutoff: float = 8.0) -> DataFrame:
    """(by, pos, category, patch): residues (pos, residue, rsa, nbrs, dists) of one entity make patches of
    exposed residues of a category that are within the cutoff; null for residues outside. Patches are
    numbered by their first residue. Entities stream through tasks in order, many in one vectorised step;
    what a task holds is a batch and the entity at its end, as long as its sequence."""
    def run(batches):
        for pdf in whole_groups(batches, by):
            n, here = len(pdf), np.arange(len(pdf))
            starts = np.r_[True, pdf[by].to_numpy()[1:] != pdf[by].to_numpy()[:-1]]
            group = np.cumsum(starts) - 1
            counts = pdf["nbrs"].map(len).to_numpy(int)
            near = pd.DataFrame({
                "a": np.repeat(here, counts), "group": np.repeat(group, counts),
                "pos": np.concatenate([np.asarray(x, np.int64) for x in pdf["nbrs"]]), "d": np.concatenate([np.asarray(x, float) for x in pdf["dists"]]),
            })
            near = near[(near["d"] > 1e-6) & (near["d"] <= cutoff)]
            near = near.merge(pd.DataFrame({"group": group, "pos": pdf["pos"].to_numpy(np.int64), "b": here}), on=["group", "pos"])
            a, b = near["a"].to_numpy(), near["b"].to_numpy()
            exposed = pdf["rsa"].to_numpy(float) >= rsa_least
            for name, allowed in CATEGORIES.items():
                member = exposed & pdf["residue"].isin(list(allowed)).to_numpy()
                both = member[a] & member[b]
                x, y = a[both], b[both]
                label = here.copy()
                while True:
                    low = np.minimum(label[x], label[y])
                    new = label.copy()
                    np.minimum.at(new, x, low)
                    np.minimum.at(new, y, low)
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                root = member & (label == here)
                upto = np.cumsum(root)
                before = (upto - root)[starts][group]
                patch = pd.array(np.where(member, upto[label] - 1 - before, 0), dtype="Int64")
                patch[~member] = pd.NA
                yield pd.DataFrame({by: pdf[by], "pos": pdf["pos"], "category": [name] * n, "patch": patch})

    kind = residues.schema[by].dataType.simpleString()
    ordered = residues.select(by, "pos", "residue", "rsa", "nbrs", "dists").repartition(by).sortWithinPartitions(by, "pos")
    return ordered.mapInPandas(run, f"{by} {kind}, pos long, category string, patch long")


def patch_pool(values: DataFrame, patches: DataFrame, by: str, col: str, weight: str | None = None) -> DataFrame:
    """Weighted sum, minimum and maximum over each patch."""
    w = F.col(weight) if weight else F.lit(1.0)
    j = values.join(patches.where("patch is not null"), [by, "pos"])
    return j.groupBy(by, "category", "patch").agg(F.sum(F.col(col) * w).alias("total"), F.min(col).alias("low"), F.max(col).alias("high"), F.count("*").alias("n"))


def fit_pca(df: DataFrame, vec: str, train: Column, k: int):
    """Mean and k components (rows) of the training rows, by one pass of sums of products in parallel.
    Each component's largest entry is made positive, so its sign is fixed."""
    t = df.where(train).select(F.col(vec).cast("array<double>").alias("v"))

    def sums(batches):
        s = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"])
                part = (len(x), x.sum(0), x.T @ x)
                s = part if s is None else tuple(a + b for a, b in zip(s, part))
        if s is not None:
            yield pd.DataFrame({"n": [s[0]], "s": [s[1].tolist()], "p": [s[2].ravel().tolist()]})

    parts = t.mapInPandas(sums, "n long, s array<double>, p array<double>").collect()  # a row for each task, dim ** 2 numbers
    n = sum(r["n"] for r in parts)
    mean = sum(np.array(r["s"]) for r in parts) / n
    cov = sum(np.array(r["p"]) for r in parts).reshape(len(mean), -1) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values, kind="stable")[:k]
    comp = vectors[:, top].T
    comp *= np.sign(comp[np.arange(k), np.abs(comp).argmax(1)])[:, None]
    return mean, comp, values[top] / values.sum()


def project(df: DataFrame, vec: str, mean: np.ndarray, comp: np.ndarray, name: str = "pc") -> DataFrame:
    """(x - mean) times the components, as expressions."""
    from quern.functions.scalar import dot

    x = F.zip_with(F.col(vec), F.array(*map(F.lit, mean.tolist())), lambda a, m: a - m)
    return df.withColumn("_x", x).withColumn(name, F.array(*[dot(F.col("_x"), F.array(*map(F.lit, c.tolist()))) for c in comp])).drop("_x")


def ema(df: DataFrame, by: str, step: str, col: str, decay: float = 0.9) -> DataFrame:
    """(by, step, ema): the exponential average of a run's steps, started at the first. Rows stream through
    tasks in order; what a task keeps is the last average."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (by, step)}

    def run(batches):
        last, mean = object(), 0.0
        for pdf in batches:
            out = []
            for k, x in zip(pdf[by].tolist(), pdf[col].astype(float).tolist()):
                mean = decay * mean + (1 - decay) * x if k == last else x
                last = k
                out.append(mean)
            yield pdf[[by, step]].assign(ema=out)

    ordered = df.select(by, step, col).repartition(by).sortWithinPartitions(by, step)
    return ordered.mapInPandas(run, f"{by} {kinds[by]}, {step} {kinds[step]}, ema double")


def checked_stats(rows: DataFrame, expected: DataFrame, key: str, col: str, length: str = "length") -> DataFrame:
    """entities, missing, mismatched, n, mean, std: statistics of the rows of entities that have as many
    rows as expected; entities without rows and with another number of them are counted and left out."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(col).alias("m"), F.var_pop(col).alias("v"))
    j = expected.select(key, length).join(per, key, "left")
    good = F.col("n") == F.col(length)
    w = lambda x: F.sum(F.when(good, F.col("n") * x))
    t = j.agg(
        F.count("*").alias("entities"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") != F.col(length)).alias("mismatched"),
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("n"), w(F.col("m")).alias("s"), w(F.col("v") + F.col("m") * F.col("m")).alias("q"),
    )
    mean = F.try_divide("s", "n")
    return t.select("entities", "missing", "mismatched", "n", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))).alias("std"))


def compact_row(scalars: Column, others: Column, mean: Column, std: Column, confidence: Column) -> Column:
    """scalars, then others standardised by position, then the confidence: one array."""
    z = F.transform(F.arrays_zip(others.alias("x"), mean.alias("m"), std.alias("s")), lambda e: (e["x"] - e["m"]) / F.greatest(e["s"], F.lit(1e-6)))
    return F.concat(scalars, z, F.array(confidence))


def schema_violations(df: DataFrame, key: str, vector: str, width: int, confidence: str, top: float = 1.0) -> DataFrame:
    """(key, kind) of rows whose vector has another width or a value that is not finite, or whose confidence
    lies outside [0, top]; nulls violate."""
    v, c = F.col(vector), F.col(confidence)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kinds = F.array_compact(F.array(
        F.when(~F.coalesce(F.size(v) == width, F.lit(False)), "width"), F.when(~F.coalesce(finite, F.lit(False)), "finite"), F.when(~F.coalesce(c.between(0.0, top), F.lit(False)), "range"),
    ))
    return df.select(key, F.explode(kinds).alias("kind"))
