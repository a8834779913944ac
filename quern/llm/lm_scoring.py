"""LM scoring by deleted interpolation of a bigram model.

    p(w | v) = a * c(v w) / c(v) + b * c(w) / N + (1 - a - b) / (V + 1)
    base(w)  = (c(w) + 1) / (N + V + 1)

v is the word before w, or the end of the text before. The weights a and b depend on the bucket of
c(v), its number of binary digits, and are learned by expectation-maximisation on held-out counts by
deletion: every training event is predicted from all training counts less that event itself.

Texts are packed once into compressed chunks of about CHUNK bytes. A chunk asks for the counts of its
distinct words and bigrams by bucket of their hash, and gives its own training counts in the same
message; each bucket adds up and replies to every chunk in the order it asked in. So what is sent
grows with distinct n-grams of a chunk, never with pairs of document and n-gram, a frequent n-gram is
one entry of each chunk, and memory is bounded by CHUNK and BUCKET. On the driver: sums over the
buckets and EM tables of fixed size.

Defined cases: a null text is empty and is one token, the end; a null doc_id trains (crc32 of nothing
is not 2 modulo 7) and is scored; rows that repeat count as often; with no training documents N = V =
0 and every score is 0 for the end token alone (log10 of 1 / 1); an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textcore import frugal, frugal_group, from_planes, mix, planes, slices, words
from quern.plans.scratch import Scratch

CHUNK = 12 << 20
BUCKET = 1_500_000  # entries in a bucket, about
LEVELS = 32  # buckets of context counts
BINS = 96  # of the logarithm of the ratio of bigram to lower-order estimate, in the EM tables
END = np.uint64(0x6C8E9CF570932BD5)
_U = np.uint64


def _tokens(raw: bytes, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the number of tokens of each text."""
    data, off = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(lens)])
    parts, counts, i = [], [], 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), "right")) - 1)
        h, n = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        out = np.empty(len(h) + len(n), _U)
        ends = np.cumsum(n + 1) - 1
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[is_word], out[ends] = h, END
        parts.append(out), counts.append(n + 1)
        i = j
    return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, _U), np.zeros(0, np.int64))


def _bigrams(tokens: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:], before[:1] = tokens[:-1], END
    return mix(before * _U(0x9FB21C651E98DF25) + mix(tokens))


def _asked(tokens: np.ndarray, weight: np.ndarray):
    """Distinct words, then distinct bigrams, each sorted, with the count of the training tokens."""
    out = []
    for kind, h in ((0, tokens), (1, _bigrams(tokens))):
        u, inv = np.unique(h, return_inverse=True)
        out.append((kind, u, np.bincount(inv, weights=weight, minlength=len(u)).astype(np.int64), inv))
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Packed texts: chunk, ids, has_id, role (1: training), lens, texts, n_tokens."""
    names = ["chunk", "ids", "has_id", "role", "lens", "texts", "n_tokens"]

    def run(batches):
        base, n_chunk = TaskContext.get().partitionId() << 32, 0
        ids, roles, lens, raws, held = [], [], [], [], 0

        def flush():
            raw, ln = b"".join(raws), np.array(lens, np.int64)
            known = np.array([x is not None for x in ids])
            cols = [base + n_chunk, np.array([x or 0 for x in ids], np.int64).tobytes(), known.astype(np.uint8).tobytes(), np.array(roles, np.uint8).tobytes(), ln.tobytes(), zstandard.compress(raw, 3), len(ln) + len(raw) // 6]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if isinstance(c, int) else pa.binary()) for c in cols], names)

        for b in batches:
            for i, j, data, off in slices(b.column(2)):
                ids += b.column(0).slice(i, j - i).to_pylist()
                roles += b.column(1).slice(i, j - i).to_pylist()
                lens += np.diff(off).tolist()
                raws.append(data.tobytes())
                held += len(data)
                if held >= CHUNK:
                    yield flush()
                    n_chunk += 1
                    ids, roles, lens, raws, held = [], [], [], [], 0
        if ids:
            yield flush()

    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    role = F.when(crc % 7 == 2, 0).otherwise(1)
    return docs.select(F.col(id_col).cast("long").alias("i"), role.cast("int").alias("r"), F.col(text_col).alias("t")).mapInArrow(frugal(run), "chunk long, ids binary, has_id binary, role binary, lens binary, texts binary, n_tokens long")


def _open(b: pa.RecordBatch, k: int):
    ids, known, role, lens, texts = (b.column(c)[k].as_py() for c in ("ids", "has_id", "role", "lens", "texts"))
    role = np.frombuffer(role, np.uint8)
    tokens, n = _tokens(zstandard.decompress(texts), np.frombuffer(lens, np.int64))
    return np.frombuffer(ids, np.int64), np.frombuffer(known, np.uint8).astype(bool), role, tokens, n


def replies(packed: DataFrame, buckets: int) -> DataFrame:
    """(chunk, kind, bucket, counts) in the order of the chunk's own sorted distinct hashes; and, as
    chunk -1, each bucket's number of known words and sum of counts."""
    def ask(batches):
        for b in batches:
            for k in range(b.num_rows):
                _, _, role, tokens, n = _open(b, k)
                rows = []
                for kind, u, c, _ in _asked(tokens, np.repeat(role > 0, n).astype(float)):
                    # sorted hashes: the buckets are ranges of the hash
                    cuts = np.searchsorted(u, np.array([-(-(x << 64) // buckets) for x in range(1, buckets)], dtype=_U))
                    for bucket, (h, own) in enumerate(zip(np.split(u, cuts), np.split(c, cuts))):
                        if len(h):
                            d = h.copy()
                            d[1:] -= h[:-1]
                            rows.append((bucket, b.column("chunk")[k].as_py(), kind, planes(d), planes(own.astype(np.uint32))))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "chunk", "kind", "h", "c"])

    def add(key, pdf):
        import pandas as pd

        out = []
        for kind, part in pdf.groupby("kind"):
            hs = [np.cumsum(from_planes(x, _U), dtype=_U) for x in part["h"]]
            h, inv = np.unique(np.concatenate(hs), return_inverse=True)
            total = np.bincount(inv, weights=np.concatenate([from_planes(x, np.uint32) for x in part["c"]]).astype(float), minlength=len(h)).astype(np.int64)
            if kind == 0:
                out.append((-1, 0, int(key[0]), np.array([(total > 0).sum(), total.sum()], np.int64).tobytes()))
            at = 0
            for chunk, own in zip(part["chunk"], hs):
                out.append((chunk, kind, int(key[0]), planes(total[inv[at : at + len(own)]].astype(np.uint32))))
                at += len(own)
        return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "counts"])

    asked = packed.mapInArrow(frugal(ask), "bucket int, chunk long, kind int, h binary, c binary")
    return asked.groupBy("bucket").applyInPandas(frugal_group(add), "chunk long, kind int, bucket int, counts binary")


def _events(doc_rows, reply_rows):
    """ids, known, role, tokens per text, and c(w), c(v), c(v w) of every token of a chunk."""
    ids, known, role, tokens, n = _open(doc_rows, 0)
    got = {0: [], 1: []}
    kinds, order, counts = (reply_rows.column(c).to_pylist() for c in ("kind", "bucket", "counts"))
    for kind, _, c in sorted(zip(kinds, order, counts), key=lambda r: r[:2]):
        got[kind].append(from_planes(c, np.uint32))
    back = [np.concatenate(got[kind])[inv].astype(np.int64) for kind, _, _, inv in _asked(tokens, np.zeros(len(tokens)))]
    end = back[0][np.flatnonzero(tokens == END)[0]] if len(tokens) else 0
    before = np.empty_like(back[0])
    before[1:], before[:1] = back[0][:-1], end
    return ids, known, role, n, back[0], before, back[1]


def _level(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(float))[1], LEVELS - 1)


def _em(table: np.ndarray, total: int, types: int, rounds: int = 60) -> np.ndarray:
    """Weights (a, b) of each level from its table of deleted events (log ratios of the three estimates)."""
    out = np.zeros((LEVELS, 2))
    grid = np.exp((np.arange(BINS) - BINS // 4) * math.log(2) / 2)  # ratio of an estimate to 1 / (V + 1)
    grid[0] = 0.0
    for lv in range(LEVELS):
        t = table[lv]
        w = np.array([0.5, 0.4, 0.1]) if lv else np.array([0.0, 0.9, 0.1])
        n = t.sum()
        if n:
            i, j = np.nonzero(t)
            c = t[i, j]
            p = np.stack([grid[i], grid[j], np.ones(len(i))])
            for _ in range(rounds):
                q = w[:, None] * p
                w = ((q / q.sum(0)) * c).sum(1) / n
            w = (w * n + np.array([0.0 if not lv else 0.5, 0.4, 0.5])) / (n + (1.4 if lv else 0.9))  # no weight is ever nought
        out[lv] = w[:2] / w.sum()
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    packed = scratch.write(chunks(docs, id_col, text_col), "chunks", codec="uncompressed")
    entries = packed.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(48, math.ceil(entries / BUCKET))
    reply = scratch.write(replies(packed, buckets), "replies")
    stats = reply.where("chunk = -1").select("counts")

    def total(batches):
        s = np.zeros(2, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                s += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(s[0])]), pa.array([int(s[1])])], ["v", "n"])

    row = stats.mapInArrow(frugal(total), "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    types, tokens = row[0] or 0, row[1] or 0
    own = reply.where("chunk >= 0")

    def bin_of(p):
        with np.errstate(divide="ignore"):
            k = np.round(np.log(p * (types + 1)) / (math.log(2) / 2)) + BINS // 4
        return np.where(p > 0, np.clip(k, 1, BINS - 1), 0).astype(np.int64)

    def learn(key, left, right):
        b = left.combine_chunks().to_batches()[0]
        _, _, role, n, c, before, both = _events(b, right)
        held = np.repeat(role > 0, n)
        c, before, both = c[held] - 1, before[held] - 1, both[held] - 1
        lv = _level(before)
        p2 = np.where(before > 0, both / np.maximum(before, 1), 0.0)
        p1 = c / max(tokens - 1, 1)
        cell = (lv * BINS + bin_of(p2)) * BINS + bin_of(p1)
        u, k = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(u, pa.int64()), "n": pa.array(k, pa.int64())})

    table = np.zeros(LEVELS * BINS * BINS)
    joined = packed.groupBy("chunk").cogroup(own.groupBy("chunk"))
    for r in joined.applyInArrow(frugal_group(learn), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r["cell"]] = r["n"]
    weights = _em(table.reshape(LEVELS, BINS, BINS), tokens, types)

    def judge(key, left, right):
        b = left.combine_chunks().to_batches()[0]
        ids, known, role, n, c, before, both = _events(b, right)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        base = np.add.reduceat(np.log10((c + 1) / (tokens + types + 1)), start)
        w = weights[_level(before)]
        none = before == 0
        a, u = np.where(none, 0.0, w[:, 0]), w[:, 1]
        if not tokens:
            a, u = np.zeros(len(c)), np.zeros(len(c))
        p = a * both / np.maximum(before, 1) + u * c / max(tokens, 1) + (1 - a - u) / (types + 1)
        s = np.add.reduceat(np.log10(p), start)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=~known), "held_out": pa.array(role == 0), "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), start), pa.int64()), "train_tokens": pa.array(np.full(len(n), tokens), pa.int64()),
            "base_score": pa.array(base), "score": pa.array(s),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.applyInArrow(frugal_group(judge), schema)


def op5_lm_scoring(spark, d):
    return score(spark.read.parquet(f"{d}/documents.parquet"))
