"""The 35 descriptor columns of a sequence, from one byte histogram and one scan for runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The amino-acid order and the nine residue groups.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
GROUPS = {
    "hydrophobic": "AVILMFWY",
    "positive": "KRH",
    "negative": "DE",
    "charged": "DEKRH",
    "aromatic": "FWY",
    "polar": "STNQCY",
    "aliphatic": "AILV",
    "turn": "GPN",
    "tiny": "ACGST",
}


NAMES = [
    *(f"aa_fraction_{a}" for a in AMINO_ACIDS), *(f"group_fraction_{g}" for g in GROUPS),
    "log1p_length", "shannon_entropy", "net_charge_fraction", "longest_hydrophobic_run_fraction", "longest_charged_run_fraction", "noncanonical_fraction",
]
SLICE = 1 << 20  # bytes that are counted at once
_COLUMN = {a: k for k, a in enumerate(AMINO_ACIDS)}
_MEMBERS = np.array([[a in s for a in AMINO_ACIDS] for s in GROUPS.values()], float).T


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of rows of about SLICE bytes."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        yield raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _longest(data: np.ndarray, off: np.ndarray, letters: str) -> np.ndarray:
    """The longest run of the letters in each text."""
    member = np.zeros(256, bool)
    member[list(letters.encode())] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    inside = member[data]
    first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])))
    out = np.zeros(len(off) - 1, np.int64)
    np.maximum.at(out, np.searchsorted(off, first, "right") - 1, last - first + 1)
    return out


def descriptors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of the figures NAMES for each text (UTF-8 bytes; lengths are in characters)."""
    n_rows = len(off) - 1
    row = np.repeat(np.arange(n_rows), np.diff(off))
    hist = np.bincount(row * 256 + data, minlength=256 * n_rows).reshape(n_rows, 256)
    length = hist[:, :128].sum(1) + hist[:, 192:].sum(1)
    n = np.maximum(length, 1)[:, None]
    letters = hist[:, list(AMINO_ACIDS.encode())].astype(float)
    share = letters / n
    charge = sum(letters[:, _COLUMN[a]] for a in "KR") - sum(letters[:, _COLUMN[a]] for a in "DE")
    rest = [
        np.log1p(length), -(share * np.log(share + 1e-12)).sum(1), charge / n[:, 0], _longest(data, off, GROUPS["hydrophobic"]) / n[:, 0],
        _longest(data, off, GROUPS["charged"]) / n[:, 0], (length - letters.sum(1)) / n[:, 0],
    ]
    return np.column_stack([share, letters @ _MEMBERS / n, *rest])


def described(df: DataFrame, col: str) -> DataFrame:
    """df without col, and the columns NAMES of it. A null text is like an empty one."""
    kept = [c for c in df.columns if c != col]

    def run(batches):
        for b in batches:
            texts = b.column(len(kept))
            got = [descriptors(data, off) for data, off in _pieces(texts)]
            table = np.concatenate(got) if got else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in table.T)], [*kept, *NAMES])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"{n} double" for n in NAMES)])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(col)).mapInArrow(run, schema)
