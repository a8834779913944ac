"""Sequence identity: the exhaustive self-join, its threshold edges, nearest neighbours and resumable shards.

SI(a, b) = LCS / (|a| + |b| - LCS): global alignment with match 1 and everything else 0, gaps taken
before mismatches; both empty 1, one empty 0.

Entities are laid out by length in blocks; a tile is a pair of blocks. A tile whose length ratio
cannot reach the threshold is never formed, a pair whose letter counts cannot reach it is never aligned
(both bounds are exact), and the rest is aligned by bit-parallel LCS, many pairs at a time. Blocks travel packed, so the join
moves blocks, not pairs; tiles are independent, hence shards and restarts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import running_sums
from quern.plans.scratch import Scratch

BLOCK = 256


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def sequence_identity(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    k = lcs(a, b)
    return k / (len(a) + len(b) - k)


def blocks(entities: DataFrame, size: int = BLOCK, idx: str = "entity_idx", seq: str = "sequence") -> DataFrame:
    """(block, shortest, longest, body): at most about 2 * size entities each, in bands of length."""
    e = entities.select(F.col(idx).alias("i"), F.col(seq).alias("s"), F.length(seq).alias("n"))
    by = running_sums(e.groupBy("n").agg(F.count("*").alias("k")), [], "n", {"upto": "k"})
    # lengths up to a block's worth share a block; a longer run of one length is dealt over several
    by = by.select("n", F.floor((F.col("upto") - 1) / size).alias("b"), F.greatest(F.lit(1), F.ceil(F.col("k") / size)).alias("parts"))
    e = e.join(by, "n").withColumn("block", F.col("b") * 1_000_000 + F.pmod(F.xxhash64("i"), "parts"))

    def pack(key, pdf):
        body = pickle.dumps((pdf["i"].to_numpy(), pdf["s"].tolist()))
        return pd.DataFrame({"block": [key[0]], "shortest": [int(pdf["n"].min())], "longest": [int(pdf["n"].max())], "body": [body]})

    return e.groupBy("block").applyInPandas(pack, "block long, shortest int, longest int, body binary")


def tiles(b: DataFrame, threshold: float, shards: int = 4096) -> DataFrame:
    """Pairs of blocks that can hold a pair at the threshold, with their shard."""
    m = b.select("block", "shortest", "longest")
    x, y = m.alias("x"), m.alias("y")
    can = (F.col("x.block") <= F.col("y.block")) & (F.least("x.longest", "y.longest") >= threshold * F.greatest("x.shortest", "y.shortest"))
    t = x.join(y, can).select(F.col("x.block").alias("bi"), F.col("y.block").alias("bj"))
    return t.withColumn("shard", F.pmod(F.xxhash64("bi", "bj"), F.lit(shards)).cast("int"))


LANES = 4096  # machine words of pairs that are aligned together


def encoded(seqs: list[str], letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers, padded with len(letters), a row for each sequence; lengths."""
    n = np.array([len(s) for s in seqs], np.int64)
    out = np.full((len(seqs), int(n.max(initial=0))), len(letters), np.int32)
    flat = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32)
    known = np.array(sorted(map(ord, letters)), np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = np.searchsorted(known, flat)
    return out, n


def lcs_pairs(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, i: np.ndarray, j: np.ndarray, n_letters: int) -> np.ndarray:
    """LCS lengths of rows i of x and j of y (as encoded): the recurrence of lcs() on words of 64 bits, each
    word of all pairs at a time."""
    words = max(1, -(-x.shape[1] // 64))
    masks = np.zeros((words, len(x), n_letters + 1), np.uint64)
    for k in range(x.shape[1]):
        live = np.flatnonzero(k < nx)
        masks[k // 64, live, x[live, k]] |= np.uint64(1 << k % 64)
    masks[:, :, n_letters] = 0
    flat, steps = masks.reshape(words, -1), np.ascontiguousarray(y.T)
    out = np.empty(len(i), np.int64)
    chunk = max(64, LANES // words)
    for at in range(0, len(i), chunk):
        p, q = i[at : at + chunk], j[at : at + chunk]
        base, own = p * (n_letters + 1), max(1, -(-int(nx[p].max(initial=0)) // 64))
        v = np.full((own, len(p)), 2**64 - 1, np.uint64)
        for k in range(int(ny[q].max(initial=0))):
            at_mask = base + steps[k, q]
            carry = None
            for w in range(own):
                u = flat[w][at_mask]
                u &= v[w]
                total = v[w] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if w + 1 < own else None
                v[w] = total | (v[w] ^ u)
        ones = np.zeros(len(p), np.int64)
        for w in range(own):
            bits = np.clip(nx[p] - 64 * w, 0, 64)
            low = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
            ones += np.bitwise_count(v[w] & low)
        out[at : at + chunk] = nx[p] - ones
    return out


def tile(left: tuple, right: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, si) of the pairs of two blocks that reach the threshold; of one block with itself each pair once."""
    (ia, sa), (ib, sb) = left, right
    letters = {c: k for k, c in enumerate(sorted(set("".join(sa)) | set("".join(sb))))}
    (x, nx), (y, ny) = encoded(sa, letters), encoded(sb, letters)
    width = len(letters) + 1
    count = [np.bincount((t + width * np.arange(len(t))[:, None]).ravel(), minlength=len(t) * width).reshape(len(t), width)[:, :-1].astype(np.int32) for t in (x, y)]
    ps, qs = [], []
    for p in range(len(sa)):
        common = np.minimum(count[0][p], count[1]).sum(1)
        ok = common >= threshold * (nx[p] + ny - common) - 1e-9
        if same:
            ok &= ia[p] < ib
        q = np.flatnonzero(ok)
        ps.append(np.full(len(q), p)), qs.append(q)
    p, q = np.concatenate(ps), np.concatenate(qs)
    k = lcs_pairs(x, nx, y, ny, p, q, len(letters))
    whole = nx[p] + ny[q] - k
    si = np.where(whole > 0, k / np.maximum(whole, 1), 1.0)
    live = si >= threshold
    a, b = ia[p[live]], ib[q[live]]
    return np.minimum(a, b), np.maximum(a, b), si[live]


def compare(b: DataFrame, t: DataFrame, threshold: float) -> DataFrame:
    """(shard, i, j, si) with i < j and SI >= threshold."""
    joined = t.join(b.select(F.col("block").alias("bi"), F.col("body").alias("left")), "bi").join(b.select(F.col("block").alias("bj"), F.col("body").alias("right")), "bj")

    def run(batches):
        for pdf in batches:
            for bi, bj, shard, left, right in zip(pdf["bi"], pdf["bj"], pdf["shard"], pdf["left"], pdf["right"]):
                i, j, si = tile(pickle.loads(left), pickle.loads(right), bi == bj, threshold)
                yield pd.DataFrame({"shard": np.full(len(i), shard), "i": i, "j": j, "si": si})

    # tiles are costly and few bytes: dealt evenly, or a task would get all tiles of its blocks
    parts = 4 * int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.select("bi", "bj", "shard", "left", "right").repartition(parts).mapInPandas(run, "shard int, i long, j long, si double")


def si_edges(entities: DataFrame, threshold: float = 0.30, size: int = BLOCK) -> DataFrame:
    b = Scratch(entities.sparkSession).write(blocks(entities, size), "blocks")
    return compare(b, tiles(b, threshold), threshold).select("i", "j", "si")


def nearest(edges: DataFrame) -> DataFrame:
    """(i, j, si): each entity's nearest by SI, ties to the smaller index. Give it unpruned edges."""
    both = edges.select("i", "j", "si").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "si"))
    best = F.max(F.struct("si", (-F.col("j")).alias("m"))).alias("b")
    return both.groupBy("i").agg(best).select("i", (-F.col("b.m")).alias("j"), "b.si")


def parse_shards(spec: str, n: int) -> set[int]:
    """`all`, or a list such as `0-2,5`; empty, reversed and out-of-range parts are errors."""
    if spec.strip() == "all":
        return set(range(n))
    out: set[int] = set()
    for part in spec.split(","):
        a, dash, b = part.strip().partition("-")
        if not a.isdigit() or dash and not b.isdigit():
            raise ValueError(f"bad shard part {part!r}")
        low, high = int(a), int(b) if dash else int(a)
        if low > high or high >= n:
            raise ValueError(f"shard part {part!r} out of range")
        out |= set(range(low, high + 1))
    return out
