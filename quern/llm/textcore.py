"""Words and shingles of whole texts as 64-bit hashes, in numpy over the bytes of Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. In UTF-8 these bytes occur
as nothing else, so bytes and characters give the same words.
"""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 1 << 19
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODE = (LOWER.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_pow: dict[str, np.ndarray] = {}
_STEP = [_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def tidy() -> None:
    """Gives freed memory back to the system: Python workers are reused, and would each keep the most
    that any batch took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def frugal(f: Callable) -> Callable:
    """A function of batches that tidies up after each batch it yields."""
    def run(batches):
        for out in f(batches):
            yield out
            del out
            tidy()

    return run


def frugal_group(f: Callable) -> Callable:
    """A function of a group's key and rows that tidies up after each group."""
    def run(key, *rows):
        out = f(key, *rows)
        tidy()
        return out

    if f.__code__.co_argcount == 2:
        return lambda key, pdf: run(key, pdf)
    return lambda key, left, right: run(key, left, right)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** k and its inverse modulo 2**64, for k up to n."""
    if len(_pow.get("up", ())) <= n:
        size = max(n + 1, SLICE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, dtype=_U)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
    return _pow["up"], _pow["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about limit bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(off) - 1, np.int64)
    gap = _SPACE[data]
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = gap[:-1]
    first[off] = True
    last = first[1:].copy()
    last[:-1] |= gap[1:]
    s = np.flatnonzero(first[:-1] & ~gap)
    e = np.flatnonzero(last & ~gap) + 1
    up, down = powers(len(data))
    run = np.zeros(len(data) + 1, _U)
    np.cumsum(_CODE[data] * up[: len(data)], out=run[1:])
    h = mix((run[e] - run[s]) * down[s] + (e - s).astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    return h, np.diff(np.searchsorted(s, off))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text). A text beyond several slices is read in
    pieces that end between words."""
    if len(off) == 2 and len(data) > 4 * SLICE:
        got, at = [], 0
        while at < len(data):
            to = at + SLICE
            while to < len(data) and not len(gaps := np.flatnonzero(_SPACE[data[to : to + SLICE]])):
                to += SLICE
            to = min(len(data), to + int(gaps[0]) if to < len(data) else to)
            got.append(_words(data[at:to], np.array([0, to - at]))[0])
            at = to
        h = np.concatenate(got)
        return h, np.array([len(h)])
    return _words(data, off)


def shingle_sets(h: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; of a text with fewer words the whole sequence."""
    if k > len(_STEP):
        raise ValueError(f"at most {len(_STEP)} words")
    m = len(h) - k + 1
    grams = mix(sum(h[j : j + m] * _STEP[j] for j in range(k))) if m > 0 else None
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            g = np.sort(grams[at : at + n - k + 1])
            keep = np.ones(len(g), bool)
            keep[1:] = g[1:] != g[:-1]
            out.append(g[keep])
        elif n:
            steps = np.array([*_STEP[:n], _U(0x2545F4914F6CDD1D)])
            own = np.append(h[at : at + n], _U(n))
            out.append(mix((own * steps).sum(keepdims=True, dtype=_U)))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal rank together, so that Spark's codec sees the runs of zeros."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


#: A sketch of bounded size: SKETCH counters in parts of PART, whatever the input.
SKETCH, PART = 1 << 20, 1 << 12


class Counters:
    """Partial counters of one task, sent as compressed parts."""

    def __init__(self):
        self.c = np.zeros(SKETCH, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        self.c += np.bincount((hashes & _U(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)

    def rows(self) -> pa.RecordBatch:
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(self.c.reshape(-1, PART)) if p.any()]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["part", "counts"])


def merge_counters(partial: DataFrame) -> np.ndarray:
    """The sums of all tasks' counters; on the driver SKETCH numbers."""
    def add(key, pdf):
        import pandas as pd

        total = np.zeros(PART, np.uint64)
        for b in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(b), np.uint32)
        return pd.DataFrame({"part": [int(key[0])], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

    out = np.zeros(SKETCH, np.uint32)
    for r in partial.groupBy("part").applyInPandas(frugal_group(add), "part int, counts binary").collect():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out
