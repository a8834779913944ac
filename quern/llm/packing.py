"""Packing by Karmarkar-Karp multiway differencing.

Each task takes its documents in groups of GROUP_TOKENS tokens. Whole windows are cut from long
documents; what remains of each document is an item. Items are divided into windows of near-equal
sums by largest differencing: of all partial partitions, the two with the largest spread are merged,
the fullest window of one with the emptiest of the other, until one is left. The window count starts at
the least that holds the items and rises, by what the excess fills, as long as a window holds more than
its capacity. Then no window is padded: free places are filled, fullest window first, with tokens cut from
the emptiest windows, until fewer tokens than a window holds are left. These odd tokens go to sequences of
power-of-two lengths, which need no padding.

No row is shuffled: a group never leaves its task, so memory is bounded by GROUP_TOKENS plus the
longest document, and a lost task is redone alone.

Defined cases: a null text is empty and has one token, the end id; a null doc_id passes through; rows
that repeat are packed each; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textcore import frugal

CAPACITY = 2048
END_ID = 1
GROUP_TOKENS = 500_000
RISE = 64  # the window count rises by its RISE-th part at least
TOKENIZER = "byte_bpe_50k"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER):
    """text -> ids of public_tokenizers' name.json. The same vocabulary and pattern by ranks is the
    faster way to the same ids; texts that it refuses, or that hold an added token of the file, go to the
    tokenizer itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    added = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if not any(t in text for t in added):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:
                if not isinstance(e, ValueError) and "Panic" not in type(e).__name__:
                    raise
        return whole.encode(text, add_special_tokens=False).ids

    return encode


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of each of k windows of near-equal sums. A partial partition keeps
    its non-empty windows only, fullest first."""
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        shared = max(0, len(a) + len(b) - k)
        # slots: a's fullest first; b's fullest takes the last slot, so b's emptiest meet a's last ones
        keep, meet = a[: len(a) - shared], a[len(a) - shared :]
        pairs = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(meet, reversed(b[len(b) - shared :]))] if shared else []
        merged = sorted(keep + pairs + b[: len(b) - shared], key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1

    def flat(t):
        out, todo = [], [t]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                out.append(x)
            else:
                todo += reversed(x)
        return out

    windows = [flat(x[1]) for x in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def _emptied(windows: list[list[tuple[int, int, int]]], capacity: int) -> int:
    """How many windows there are beyond those that all tokens can fill."""
    return len(windows) - sum(i[2] for w in windows for i in w) // capacity


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document number, start, length, sequence number, offset) that hold every token once."""
    pieces, n_seq, items = [], 0, []
    for d, n in enumerate(lengths):
        for s in range(0, n - capacity + 1, capacity):
            pieces.append((d, s, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            items.append((d, n - n % capacity, n % capacity))
    k = -(-sum(i[2] for i in items) // capacity)
    windows = differencing([i[2] for i in items], k)
    while excess := sum(max(0, sum(items[i][2] for i in w) - capacity) for w in windows):
        k += max(-(-excess // capacity), -(-k // RISE))
        windows = differencing([i[2] for i in items], k)
    # fullest first; the emptiest give their tokens to the free places of the fuller ones
    windows = sorted(([items[i] for i in w] for w in windows), key=lambda w: -sum(i[2] for i in w))
    spare = [i for w in reversed(windows[len(windows) - _emptied(windows, capacity) :]) for i in w]
    for w in windows[: len(windows) - _emptied(windows, capacity)]:
        free = capacity
        while free:
            d, s, n = w.pop() if w else spare.pop()
            take = min(n, free)
            pieces.append((d, s, take, n_seq, capacity - free))
            free -= take
            if take < n:
                spare.append((d, s + take, n - take))
        n_seq += 1
    rest = spare
    left = sum(i[2] for i in rest)
    free = fill = 0
    for d, s, n in rest:
        while n:
            if not free:
                fill = free = 1 << (left.bit_length() - 1)
                left -= fill
                n_seq += 1
            take = min(n, free)
            pieces.append((d, s, take, n_seq - 1, fill - free))
            s, n, free = s + take, n - take, free - take
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row for each piece. with_ids: also its ids (little-endian unsigned 32 bits)."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches):
        encode, base, n_seq = encoder(tokenizer), TaskContext.get().partitionId() << 36, 0
        ids, arrays, held = [], [], 0

        def flush():
            nonlocal n_seq, ids, arrays, held
            got = pack_group([len(a) for a in arrays], capacity)
            cols = [[], [], [], [], [], [], [], []]
            for d, s, n, q, o in got:
                raw = arrays[d][s : s + n].astype("<u4").tobytes()
                for c, v in zip(cols, (ids[d], s, n, zlib.crc32(raw), len(arrays[d]), base + n_seq + q, o, raw)):
                    c.append(v)
            n_seq += 1 + max((g[3] for g in got), default=0)
            ids, arrays, held = [], [], 0
            out = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = encode(text.as_py() or "")
                tokens.append(end_id)
                ids.append(i)
                arrays.append(np.array(tokens, dtype=np.uint32))
                held += len(tokens)
                if held >= GROUP_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(frugal(run), schema)


def op6_packing(spark, d):
    return pack(spark.read.parquet(f"{d}/documents.parquet"))
