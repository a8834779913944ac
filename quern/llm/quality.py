"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts come from their bytes, by the slice, in numpy. Trees are grown level by
level on binned statistics of a bounded sample of labelled rows, with logistic loss, and flattened
into arrays of complete binary trees: a batch goes through a tree in DEPTH vectorised steps.

Bounds: TRAIN labelled training rows, chosen by the hash of their id where there are more. The table
of statistics (a few dozen floats a document) is written once and read by fit and scoring.

Defined cases: a null text is empty, an empty text has a score like any other; where a document has
several labels their mean counts; null labels are none; with no labelled rows every score is 0.5, with
labels of one kind it is that label; a null doc_id is scored, never learned from; rows that repeat are
scored alike; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textcore import frugal, slices, words
from quern.plans.scratch import Scratch

TRAIN = 16_000
TREES, DEPTH, BINS, RATE = 120, 5, 64, 0.12
LEAST_LEAF, RIDGE = 20, 1.0
_SETS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "line": [10], "space": [32, 9, 13], "stop": b".!?", "comma": b",;:", "bang": b"!", "star": b"*",
    "money": b"$%", "amp": b"&#", "bar": b"|", "angle": b"<>{}[]()", "slash": b"/\\_=", "at": b"@", "quote": b"\"'`", "high": range(128, 256), "control": [*range(9), 11, 12, *range(14, 32), 127],
}
_CLASS = np.zeros((256, len(_SETS)), bool)
for _k, _s in enumerate(_SETS.values()):
    _CLASS[list(_s), _k] = True
N_STATS = len(_SETS) + 15


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of N_STATS numbers for each text."""
    n = np.diff(off).astype(float)
    size = np.maximum(n, 1)
    cols = []
    for k in range(len(_SETS)):
        run = np.concatenate([[0], np.cumsum(_CLASS[:, k][data])])
        cols.append((run[off[1:]] - run[off[:-1]]) / size)
    h, count = words(data, off)
    rest, at = np.zeros((len(n), 15)), 0
    for d, w in enumerate(count.tolist()):
        own = h[at : at + w]
        at += w
        text = data[off[d] : off[d + 1]]
        hist = np.bincount(text, minlength=256)
        p = hist[hist > 0] / max(len(text), 1)
        lines = text.tobytes().split(b"\n")
        m = max(w, 1)
        u, c = np.unique(own, return_counts=True)
        pairs = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) if w > 1 else 0
        four = len(np.unique(own[3:] * np.uint64(3) + own[2:-1] * np.uint64(5) + own[1:-2] * np.uint64(7) + own[:-3])) if w > 4 else w
        rest[d] = (
            np.log1p(len(text)), np.log1p(w), len(text) / m, len(u) / m, (c.max() if w else 0) / m, (own[1:] == own[:-1]).sum() / m, pairs / m, four / m,
            -(p * np.log2(p)).sum(), np.log1p(len(lines)), len(text) / len(lines), len(set(lines)) / len(lines), max(map(len, lines)) / max(len(text), 1),
            (c == 1).sum() / m, hist.max() / max(len(text), 1),
        )
    return np.column_stack([*cols, rest]).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays of TREES complete trees: feature and threshold of inner nodes, value of leaves."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    mean = float(y.mean()) if len(y) else 0.0
    model = {"feature": np.zeros((TREES, inner), np.int32), "threshold": np.full((TREES, inner), np.inf, np.float32), "value": np.zeros((TREES, leaves)), "start": np.array(0.0)}
    if not len(y) or not 0 < mean < 1:
        model["start"] = np.array([0.0 if not len(y) else np.inf if mean == 1 else -np.inf])[0]
        return model
    model["start"] = np.array(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin b: edges[b - 1] < x <= edges[b]
    raw = np.full(len(y), float(model["start"]))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, w = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-6)
            feature, cut = np.zeros(width, np.int64), np.full(width, BINS)
            for f in range(x.shape[1]):
                at = node * BINS + binned[:, f]
                gs, ws, ns = (np.bincount(at, weights=v, minlength=width * BINS).reshape(width, BINS).cumsum(1) for v in (g, w, None))
                gt, wt, nt = gs[:, -1:], ws[:, -1:], ns[:, -1:]
                gain = gs**2 / (ws + RIDGE) + (gt - gs) ** 2 / (wt - ws + RIDGE) - gt**2 / (wt + RIDGE)
                gain[(ns < LEAST_LEAF) | (nt - ns < LEAST_LEAF)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], feature[better], cut[better] = top[better], f, k[better]
            for q in range(width):
                if cut[q] < BINS:
                    model["feature"][t, first + q], model["threshold"][t, first + q] = feature[q], edges[feature[q]][min(cut[q], len(edges[feature[q]]) - 1)]
            node = node * 2 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        top, low = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=w, minlength=leaves)
        model["value"][t] = RATE * top / (low + RIDGE)
        raw += model["value"][t][node]
    return model


def probability(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    raw, rows = np.full(len(x), float(model["start"])), np.arange(len(x))
    for f, t, v in zip(model["feature"], model["threshold"], model["value"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, f[node]] > t[node])
        raw += v[node - ((1 << DEPTH) - 1)]
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-raw))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1

    def measure(batches):
        for b in batches:
            for i, j, data, off in slices(b.column(2)):
                x = statistics(data, off)
                stats = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATS).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), stats], ["doc_id", "held_out", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("t"))
    table = scratch.write(rows.mapInArrow(frugal(measure), "doc_id long, held_out boolean, stats array<float>"), "stats")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(label_col).alias("y"))
    part = table.where(~F.col("held_out")).join(known, "doc_id")
    n = part.select("doc_id").count()
    rank = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / (1 << 30)
    sample = part.where(rank < min(1.0, bound / max(n, 1))).select("doc_id", "y", "stats").toArrow().sort_by("doc_id")
    x = np.array(sample["stats"].to_pylist(), np.float32).reshape(-1, N_STATS)
    model = spark.sparkContext.broadcast(train(x, np.round(sample["y"].to_numpy().astype(float))))

    def judge(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            p = probability(model.value, x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(frugal(judge), "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"))
