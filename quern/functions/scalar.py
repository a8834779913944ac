"""Scalar expressions over columns (strings, hashes, logits, losses). All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_hash(c, upper: bool = True) -> Column:
    """SHA-256 of the trimmed sequence; upper-cased first unless told otherwise."""
    t = F.trim(c)
    return F.sha2(F.upper(t) if upper else t, 256)


def stable_tiebreak(seed: int, component: Column, split: Column) -> Column:
    """First 16 hexadecimal digits of the digest of "seed:component:split": they order as the unsigned 64-bit number does."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), component, split), 256), 1, 16)


def count_of(c, alphabet: str) -> Column:
    """Characters of c that are in alphabet."""
    return F.length(c) - F.length(F.translate(c, alphabet, ""))


def longest_run(c, alphabet: str) -> Column:
    """Length of the longest run of characters in alphabet."""
    runs = F.split(F.regexp_replace(c, f"[^{alphabet}]+", " "), " ")
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def entropy_bits(c) -> Column:
    """Shannon entropy in bits over all characters; 0 for an empty string."""
    n = F.length(c)
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    share = F.transform(F.array_distinct(chars), lambda x: (n - F.length(F.replace(c if isinstance(c, Column) else F.col(c), x, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def sigmoid(x) -> Column:
    x = F.greatest(F.least(x if isinstance(x, Column) else F.col(x), F.lit(50.0)), F.lit(-50.0))
    return 1 / (1 + F.exp(-x))


def logit(p, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(p if isinstance(p, Column) else F.col(p), F.lit(1 - eps)), F.lit(eps))
    return F.log(p / (1 - p))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(x: Column, y: Column) -> Column:
    return softplus(x) - x * y


def smooth_l1(p: Column, y: Column, beta: float = 1.0) -> Column:
    d = F.abs(p - y)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def smoothed_label(y: Column, s: float) -> Column:
    return y * (1 - s) + s / 2


def rbf(d: Column, low: float, high: float, n: int) -> list[Column]:
    """n Gaussian basis values with centres evenly from low to high and their spacing as width."""
    step = (high - low) / (n - 1)
    return [F.exp(-F.pow((d - (low + k * step)) / step, 2)) for k in range(n)]


def sinusoid(pos: Column, dim: int) -> list[Column]:
    """Alternating sine and cosine of the position at geometric frequencies."""
    rates = [math.exp(-math.log(10000.0) * (2 * (k // 2)) / dim) for k in range(dim)]
    return [(F.sin if k % 2 == 0 else F.cos)(pos * r) for k, r in enumerate(rates)]


def fixed_chunks(c, size: int) -> Column:
    """Consecutive pieces of at most size characters; none of an empty string."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c), F.lit(size)), lambda p: F.substr(c, p, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def value_bin(v: Column) -> Column:
    """Tenths of the value clipped to [0, 1]; the last is closed."""
    return F.least(F.floor(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)) * 10), F.lit(9)).cast("int")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))
