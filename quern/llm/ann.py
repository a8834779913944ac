"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are extended by one component to equal length, so the largest inner product is the least
distance, and projected to M dimensions by a Gaussian (2-stable) matrix: the squared projected distance
of two vectors at distance r is r**2 times a chi-square variable of M degrees. A kd-tree over the
projected points is fitted on a bounded sample; every row is indexed in its leaf, and leaves are divided
into blocks of bounded size. A query first searches its own block, which bounds the distance of its
k-th neighbour, and then the blocks of the leaves in reach. Within a block the tree goes on to leaves of
about STEP rows, at every size of the table: a query takes in its projected neighbours leaf by leaf, in
order of projected distance, and verifies them; it stops where a neighbour nearer than the k-th found
would have shown a smaller projected distance with the probability of CONFIDENCE_Z. Queries of one leaf are
verified together. Scores are exact. Of equal vectors only the k + 1 smallest ids can be among the nearest.

Queries travel in blocks, data blocks stay packed, and a block returns at most k rows of a query. The
tree (LEAVES leaves) and the sample (SAMPLE rows) are the only things on the driver.

Defined cases: vectors that are null, zero, of an uncommon length, or hold null or non-finite
components take no part, as queries or candidates; null ids neither; rows that repeat an id and a
vector count once, and candidates with the query's own id are its own; ties go to the smaller id; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.textcore import frugal, frugal_group
from quern.llm.vectors import dots, matrix, usable, width
from quern.plans.scratch import Scratch

M = 12
CONFIDENCE_Z = 2.05  # normal quantile of the stopping test's probability, 0.98
SAMPLE, LEAVES, LEAF = 32_768, 1024, 2048
BLOCK = 4096
STEP = 64  # rows that a query verifies at a time, about
STRAND = 64  # query blocks that meet a data block in one task


def chi_square_bound(m: int = M, z: float = CONFIDENCE_Z) -> float:
    """Upper quantile of the chi-square distribution (Wilson and Hilferty)."""
    return m * (1 - 2 / (9 * m) + z * math.sqrt(2 / (9 * m))) ** 3


def kd_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split dimension and value of the inner nodes of a complete tree; lower and upper corner of each leaf."""
    m = points.shape[1]
    dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    todo = {0: (points, np.full(m, -np.inf), np.full(m, np.inf))}
    for node in range((1 << depth) - 1):
        own, lo, hi = todo.pop(node)
        d = int(own.var(0).argmax()) if len(own) > 1 else 0
        c = float(np.median(own[:, d])) if len(own) else 0.0
        dims[node], cuts[node] = d, c
        up, down = hi.copy(), lo.copy()
        up[d], down[d] = min(hi[d], c), max(lo[d], c)
        right = own[:, d] > c if len(own) else np.zeros(0, bool)
        todo[2 * node + 1], todo[2 * node + 2] = (own[~right], lo, up), (own[right], down, hi)
    ends = [todo[k] for k in sorted(todo)]
    return dims, cuts, np.array([e[1] for e in ends]), np.array([e[2] for e in ends])


def leaf_of(p: np.ndarray, dims: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    node, rows = np.zeros(len(p), np.int64), np.arange(len(p))
    for _ in range(depth):
        node = 2 * node + 1 + (p[rows, dims[node]] > cuts[node])
    return node - ((1 << depth) - 1)


def distinct(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block by id, of equal vectors the k + 1 smallest ids, of equal ids and vectors one."""
    order = np.argsort(ids, kind="stable")
    kinds = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, kind = np.unique(kinds, return_inverse=True)
    by = np.lexsort((ids[order], kind))
    new = np.ones(len(by), bool)
    new[1:] = (kind[by][1:] != kind[by][:-1]) | (ids[order][by][1:] != ids[order][by][:-1])
    by = by[new]
    first = np.ones(len(by), bool)
    first[1:] = kind[by][1:] != kind[by][:-1]
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    return np.sort(order[by[np.arange(len(by)) - start <= k]])


class Block:
    """Rows of a block under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, project, k: int):
        live = distinct(ids, x, k)
        self.ids, self.x, self.project, self.k = ids[live], x[live], project, k
        p = project(self.x, False)
        depth = max(0, math.ceil(math.log2(max(len(p), 1) / STEP)))
        leaf = leaf_of(p, *kd_tree(p, depth)[:2], depth)
        order = np.argsort(leaf, kind="stable")
        self.leaves = [own for own in np.split(order, np.searchsorted(leaf[order], np.arange(1, 1 << depth))) if len(own)]
        self.low, self.high = (np.array([f(p[own], axis=0) for own in self.leaves]) for f in (np.min, np.max))

    def search(self, q: np.ndarray, qid: np.ndarray, longest: float, reach: float, kth: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, int]:
        """The k best rows of each query that reach its k-th score so far; the k-th scores after; rows verified."""
        k, n = self.k, len(q)
        p, size = self.project(q, True), (q * q).sum(1) + longest
        gap = np.empty((n, len(self.leaves)))
        for at in range(len(self.leaves)):
            out = np.maximum(np.maximum(self.low[at] - p, p - self.high[at]), 0)
            gap[:, at] = (out * out).sum(1)
        turn = np.argsort(gap, axis=1, kind="stable")
        best, kth = np.full((n, k), -np.inf), kth.copy()
        slack = 1e-9 * (1 + size)
        found, verified, live = [], 0, np.arange(n)
        for r in range(len(self.leaves)):
            leaf = turn[live, r]
            stay = gap[live, leaf] <= reach * np.maximum(size[live] - 2 * kth[live], 0)
            live, leaf = live[stay], leaf[stay]
            if not len(live):
                break
            order = np.argsort(leaf, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                rows, asks = self.leaves[leaf[own[0]]], live[own]
                rough = q[asks] @ self.x[rows].T
                rough[self.ids[rows][None, :] == qid[asks][:, None]] = -np.inf
                verified += rough.size
                both = np.concatenate([best[asks], rough], axis=1)
                best[asks] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[asks] = np.maximum(kth[asks], best[asks].min(1))
                i, j = np.nonzero((rough >= (kth[asks] - slack[asks])[:, None]) & np.isfinite(rough))
                found.append((asks[i], rows[j], rough[i, j]))
        if not found:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}), kth, verified
        i, j, rough = (np.concatenate(c) for c in zip(*found))
        near = rough >= kth[i] - slack[i]
        i, j = i[near], j[near]
        exact = dots(self.x[j], q[i])
        order = np.lexsort((self.ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.ones(len(i), bool)
        first[1:] = i[1:] != i[:-1]
        keep = np.arange(len(i)) - np.flatnonzero(first)[np.cumsum(first) - 1] < k
        return pd.DataFrame({"query_id": qid[i[keep]], "vec_id": self.ids[j[keep]], "score": exact[keep]}), kth, verified


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", m: int = M) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows by inner product."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    out_schema = "query_id long, vec_id long, score double"
    dim = width(vectors, vec_col)
    good = vectors.where(usable(vec_col) & (F.size(vec_col) == dim) & F.col(id_col).isNotNull())
    good = good.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.col(vec_col).cast("array<double>").alias("v"))
    stat = good.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    n, longest = stat["n"], (stat["top"] or 0.0) * (1 + 1e-12)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plane = np.random.default_rng(7).standard_normal((dim + 1, m))
    reach = chi_square_bound(m)

    def projected(x: np.ndarray, query: bool) -> np.ndarray:
        own = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
        return x @ plane[:dim] + own[:, None] * plane[dim]

    share = min(1.0, SAMPLE / n)
    drawn = good.where(F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(2 * SAMPLE).toArrow()
    depth = min(int(math.log2(LEAVES)), max(0, math.ceil(math.log2(n / LEAF))))
    tree = kd_tree(projected(matrix(drawn["v"], dim), False) if drawn.num_rows else np.zeros((0, m)), depth)

    def index(batches):
        for b in batches:
            x = matrix(b.column(2), dim)
            leaf = leaf_of(projected(x, False), tree[0], tree[1], depth)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "q", "leaf", "v"])

    rows = scratch.write(good.mapInArrow(frugal(index), "id long, q boolean, leaf int, v binary"), "indexed")
    counts = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # LEAVES rows at most
    blocks = {leaf: max(1, math.ceil(c / BLOCK)) for leaf, c in counts.items()}
    firsts, at = {}, 0
    for leaf in sorted(blocks):
        firsts[leaf], at = at, at + blocks[leaf]
    n_blocks = at
    where = F.broadcast(spark.createDataFrame([(leaf, firsts[leaf], blocks[leaf]) for leaf in blocks], "leaf int, first int, parts int"))
    strands = math.ceil(n_blocks / STRAND)
    corners = (tree[2], tree[3])

    def pack(key, pdf):
        ids, query = pdf["id"].to_numpy(), pdf["q"].fillna(False).to_numpy(bool)
        x = np.frombuffer(b"".join(pdf["v"]), float).reshape(-1, dim)
        block = int(key[0])
        asks = np.flatnonzero(query)
        asks = asks[distinct(ids[asks], x[asks], len(asks))]
        held = Block(ids, x, projected, k)
        out = [(block, -1, "data", pickle.dumps((held.ids, held.x)))]
        if len(asks):
            q, qid = x[asks], ids[asks]
            found, kth, _ = held.search(q, qid, longest, reach, np.full(len(q), -np.inf))
            out.append((block, -2, "found", pickle.dumps(found)))
            p = projected(q, True)
            r2 = reach * np.maximum((q * q).sum(1) + longest - 2 * kth, 0)
            for leaf in blocks:
                gap = np.maximum(np.maximum(corners[0][leaf] - p, p - corners[1][leaf]), 0)
                go = (gap * gap).sum(1) <= r2
                if go.any():
                    body = pickle.dumps((qid[go], q[go], kth[go]))
                    out += [(to, block % strands, "ask", body) for to in range(firsts[leaf], firsts[leaf] + blocks[leaf]) if to != block]
        return pd.DataFrame(out, columns=["block", "strand", "kind", "body"])

    placed = rows.join(where, "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = placed.select("block", "id", "q", "v").groupBy("block").applyInPandas(frugal_group(pack), "block int, strand int, kind string, body binary")
    packed = scratch.write(packed, "packed")

    def unpack(batches):
        for b in batches:
            for body in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pandas(pickle.loads(body), preserve_index=False)

    seeds = packed.where("kind = 'found'").select("body").mapInArrow(frugal(unpack), out_schema)

    def match(key, pdf):
        data = [b for kind, b in zip(pdf["kind"], pdf["body"]) if kind == "data"]
        asks = [pickle.loads(b) for kind, b in zip(pdf["kind"], pdf["body"]) if kind == "ask"]
        if not data or not asks:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        qid, q, kth = (np.concatenate(c) for c in zip(*asks))
        return Block(*pickle.loads(data[0]), projected, k).search(q, qid, longest, reach, kth)[0]

    data = packed.where("kind = 'data'").withColumn("strand", F.explode(F.sequence(F.lit(0), F.lit(strands - 1))))
    met = data.select("block", "strand", "kind", "body").union(packed.where("kind = 'ask'").select("block", "strand", "kind", "body"))
    others = met.groupBy("block", "strand").applyInPandas(frugal_group(match), out_schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return seeds.union(others).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_ann(spark, d):
    return search(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
