"""Embedding near-dedup by E8 lattice hashing.

Vectors are normalised; equal ones are one class with a weight. In each of TABLES tables a class is
projected to eight dimensions by a random matrix, divided by SCALE and decoded to its nearest point of
the E8 lattice, its own cell; of the 240 cells around it the PROBES nearest are visited too. Classes
that meet in a cell, one of them at home there, are candidates; all of them are verified by their
cosine in double precision. A pair counts at its first meeting only, which both sides can work out,
so links are counted without listing pairs; each task also returns a spanning forest of its links,
from which components are made.

A cell with more than BLOCK classes is cut into parts, and every two parts meet in a task of their
own; small cells share tasks. The expected share of pairs at cosine 0.9 that meet is 0.986, and more
above.

Defined cases: vectors that are null, zero, of an uncommon length, or hold null or non-finite
components link with nothing; rows with a null id take no part (component_id null, kept false); rows
that repeat are copies and link; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textcore import frugal, frugal_group, mix
from quern.llm.vectors import dots, matrix, usable, width
from quern.operators.graph import connected_components
from quern.plans.scratch import Scratch

TABLES, PROBES, SCALE = 5, 6, 1.4
THRESHOLD = 0.9
BLOCK = 2048
SMALL = 256  # classes in a cell that shares its task
SHARED = 4096  # rows of such a task, about


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: all (±2, ±2, 0...) and all (±1...) with an even number of minus signs."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (2, -2) for b in (2, -2)]
    out = np.zeros((len(pairs), 8))
    for r, (i, j, a, b) in zip(out, pairs):
        r[i], r[j] = a, b
    halves = np.array([s for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0], float)
    return np.concatenate([out, halves])


ROOTS = roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of an even sum: round, and if the sum is odd round the coordinate that was least certain the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    gap = (x - r)[odd]
    k = np.abs(gap).argmax(1)
    r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point, doubled: E8 is D8 and D8 shifted by a half in every coordinate."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return 2 * np.where(near[:, None], a, b)


def _name(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit names of doubled lattice points."""
    h = np.full(points.shape[:-1], np.uint64(table + 1))
    for k in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.rint(points[..., k]).astype(np.int64).astype(np.uint64))
    return h.astype(np.int64)


def cells(x: np.ndarray, planes: np.ndarray, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: own cell in each table, and the cells visited besides."""
    own, seen = [], []
    for t, g in enumerate(planes):
        y = (x @ g) / scale
        c = decode(y)
        far = -2 * ((y - c / 2) @ (ROOTS.T / 2))  # the squared length of a root is the same for all
        k = np.argsort(far, axis=1, kind="stable")[:, :probes]
        own.append(_name(c, t))
        seen.append(_name(c[:, None, :] + ROOTS[k], t))
    return np.stack(own, 1), np.stack(seen, 1)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row linked to each row, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    dim = width(vectors, vec_col)
    fits = usable(vec_col) & (F.size(vec_col) == dim) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, F.col(vec_col).cast("array<double>")).alias("v"))
    rows = rows.withColumn("sig", F.when(F.col("v").isNotNull(), F.sha2(F.array_join("v", ",").cast("binary"), 256)))
    classes = rows.where("sig is not null").groupBy("sig").agg(F.first("v").alias("v"), F.count("*").alias("w"), F.min("vec_id").alias("low"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    planes = np.random.default_rng(8).standard_normal((tables, max(dim, 1), 8))

    def unit(x):
        return x / np.sqrt(dots(x, x))[:, None]

    def hash_rows(batches):
        for b in batches:
            own, seen = cells(unit(matrix(b.column(1), dim)), planes, probes, scale)
            n = len(own)
            cell = np.concatenate([own.ravel(), seen.ravel()])
            cid = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([np.repeat(cid, tables), np.repeat(cid, tables * probes)])), pa.array(np.repeat([True, False], [n * tables, n * tables * probes]))], ["cell", "cid", "home"])

    keys = scratch.write(classes.select("cid", "v").mapInArrow(frugal(hash_rows), "cell long, cid long, home boolean"), "keys")
    count = keys.groupBy("cell").agg(F.count_if("home").alias("r"), F.count("*").alias("n")).where("r > 0 and n > 1")
    live = keys.join(count, "cell")
    parts = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    live = live.withColumns({"pr": parts(F.col("r")), "pv": parts(F.col("n") - F.col("r"))})
    mine = F.pmod(F.xxhash64("cid", F.lit("part")), F.when(F.col("home"), F.col("pr")).otherwise(F.col("pv"))).cast("int")
    live = live.withColumn("part", mine)
    # a task is (x, y): parts x and y of the home classes, or with y < 0 part x of them and part -1 - y of the visitors
    others = F.sequence(F.lit(0), F.col("pr") - 1)
    visited = F.when(F.col("pv") > 0, F.sequence(F.lit(0), F.col("pv") - 1)).otherwise(F.array().cast("array<int>"))
    at_home = F.concat(
        F.transform(others, lambda j: F.struct(F.least("part", j).alias("x"), F.greatest("part", j).alias("y"))),
        F.transform(visited, lambda j: F.struct(F.col("part").alias("x"), (-1 - j).alias("y"))),
    )
    away = F.transform(others, lambda j: F.struct(j.alias("x"), (-1 - F.col("part")).alias("y")))
    n_small = F.col("n") <= SMALL
    tasks = live.select("cell", "cid", "home", "part", "n", F.explode(F.when(F.col("home"), at_home).otherwise(away)).alias("t")).select("cell", "cid", "home", "part", "n", "t.x", "t.y")
    total = keys.count()
    groups = max(1, total // SHARED)
    tasks = tasks.withColumn("g", F.when(n_small, F.pmod(F.xxhash64("cell"), F.lit(groups))).otherwise(F.xxhash64("cell", "x", "y"))).drop("n")
    full = tasks.join(classes.select("cid", "w", "v"), "cid")

    def meet(key, pdf):
        pdf = pdf.sort_values(["cell", "x", "y", "cid"], ignore_index=True)
        raw = np.concatenate(pdf["v"].to_numpy()).reshape(-1, dim)
        norm = np.sqrt(dots(raw, raw))
        x = raw / norm[:, None]
        cid, w, home, part = pdf["cid"].to_numpy(), pdf["w"].to_numpy().astype(float), pdf["home"].to_numpy(), pdf["part"].to_numpy()
        c, px, py = pdf["cell"].to_numpy(), pdf["x"].to_numpy(), pdf["y"].to_numpy()
        cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(px) != 0) | (np.diff(py) != 0)) + 1
        links, edges_a, edges_b = np.zeros(len(pdf)), [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
            h = np.arange(lo, hi)[home[lo:hi]]
            v = np.arange(lo, hi)[~home[lo:hi]] if py[lo] < 0 else h
            if py[lo] >= 0 and px[lo] != py[lo]:
                # two parts of the home classes: only pairs between them
                h, v = h[part[h] == px[lo]], h[part[h] == py[lo]]
            for a in range(0, len(h), 512):
                hh = h[a : a + 512]
                i, j = np.nonzero(x[hh] @ x[v].T >= threshold - 1e-9)
                i, j = hh[i], v[j]
                if py[lo] >= 0 and px[lo] == py[lo]:
                    keep = cid[i] < cid[j]
                    i, j = i[keep], j[keep]
                keep = dots(raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                edges_a.append(i), edges_b.append(j)
                used, inv = np.unique(np.concatenate([i, j]), return_inverse=True)
                own, seen = cells(x[used], planes, probes, scale)
                p, q = inv[: len(i)], inv[len(i) :]
                here = np.flatnonzero((own[p[:1]] == c[lo])[0])[0]  # the home side names the table
                new = np.ones(len(i), bool)
                for t in range(here + 1):
                    pq = (seen[q, t] == own[p, t][:, None]).any(1)
                    qp = (seen[p, t] == own[q, t][:, None]).any(1)
                    new &= ~(((own[p, t] == own[q, t]) | pq | qp) if t < here else (py[lo] < 0) & qp & (cid[j] < cid[i]))
                links += np.bincount(i[new], weights=w[j[new]], minlength=len(pdf)) + np.bincount(j[new], weights=w[i[new]], minlength=len(pdf))
        if not edges_a:
            return pd.DataFrame({"cid": np.zeros(0, np.int64), "k": np.zeros(0, np.int64), "peer": np.zeros(0, np.int64)})
        # rows of one class, which a shared task may hold several times, are one node
        names, node = np.unique(cid, return_inverse=True)
        label = _forest(len(names), node[np.concatenate(edges_a)], node[np.concatenate(edges_b)])
        k = np.bincount(node, weights=links, minlength=len(names))
        out = (k > 0) | (label != np.arange(len(names)))
        return pd.DataFrame({"cid": names[out], "k": k[out].astype(np.int64), "peer": names[label[out]]})

    found = scratch.write(full.groupBy("g").applyInPandas(frugal_group(meet), "cid long, k long, peer long"), "links")
    links = found.groupBy("cid").agg(F.sum("k").alias("k"))
    root = connected_components(found.select(F.col("cid").alias("a"), F.col("peer").alias("b")), scratch).withColumnRenamed("node", "cid")
    own = classes.select("sig", "cid", "w", "low").join(links, "cid", "left").join(root, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = own.groupBy("root").agg(F.min("low").alias("least"))
    named = own.join(least, "root").select("sig", (F.coalesce("k", F.lit(0)) + F.col("w") - 1).alias("k"), "least")
    out = rows.select("vec_id", "sig").join(named, "sig", "left")
    comp = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("k", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op8_lattice_dedup(spark, d):
    return near_duplicates(spark.read.parquet(f"{d}/embeddings.parquet"))


#: All pairs by brute force: its rows are the operator's where every linked pair meets in a table.
ORACLE = """
WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
l AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.j, r.root FROM r JOIN l ON r.node = l.i WHERE r.root < l.j),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT i, count(*) AS k FROM l GROUP BY i)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.i = vec_id
"""
