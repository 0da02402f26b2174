"""Two-text dynamic programmes as Arrow-batched UDFs, where no built-in exists.

Each takes two string columns and gives null for a null argument.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType

from loomtext.functions import batch_kernels


def osa_distance(a: str, b: str) -> int:
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


def damerau_distance(a: str, b: str) -> int:
    """Unrestricted: a true metric."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            if x == y:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (x != y), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[len(a), len(b)]


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel: one big-integer step for each character."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = row & places.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    m, right = len(left), [y for y, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, boost_from: float = 0.0) -> float:
    base = jaro(a, b)
    if base < boost_from:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base)


def needleman_wunsch(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> int:
    last = [j * gap for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i * gap]
        for j, y in enumerate(b, 1):
            row.append(max(last[j - 1] + (match if x == y else mismatch), last[j] + gap, row[-1] + gap))
        last = row
    return last[-1]


def smith_waterman(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> int:
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, last[j - 1] + (match if x == y else mismatch), last[j] + gap, row[-1] + gap))
        best, last = max(best, *row), row
    return best


def _column(kernel: Callable, kind: DataType):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(apply, kind)


def _batch_column(run: Callable, kind: DataType):
    """A Column function from one of two lists of texts."""

    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        out = np.full(len(a), None, dtype=object)
        if len(known):
            out[known] = run(a.iloc[known].tolist(), b.iloc[known].tolist()).tolist()
        return pd.Series(out)

    return F.pandas_udf(apply, kind)


_jaro_of = batch_kernels.batched(batch_kernels.jaro, np.float64)


def _jaro_winkler_of(prefix: int, scale: float, boost_from: float) -> Callable:
    def run(a: list[str], b: list[str]) -> np.ndarray:
        base = _jaro_of(a, b)
        same = np.array([len(os.path.commonprefix((x[:prefix], y[:prefix]))) for x, y in zip(a, b, strict=True)])
        return np.where(base >= boost_from, base + same * scale * (1 - base), base)

    return run


# The functions of two texts above are what these are held against.
osa = _batch_column(batch_kernels.batched(batch_kernels.osa, np.int64), IntegerType())
damerau = _batch_column(batch_kernels.batched(batch_kernels.damerau, np.int64), IntegerType())
lcs = _column(lcs_length, IntegerType())
jaro_sim = _batch_column(_jaro_of, DoubleType())
jaro_winkler_sim = _batch_column(_jaro_winkler_of(4, 0.1, 0.0), DoubleType())
jaro_winkler_boosted_sim = _batch_column(_jaro_winkler_of(4, 0.1, 0.7), DoubleType())
nw_score = _batch_column(batch_kernels.batched(batch_kernels.needleman_wunsch(), np.int64), IntegerType())
sw_score = _batch_column(batch_kernels.batched(batch_kernels.smith_waterman(), np.int64), IntegerType())


def lcs_distance(a: Column, b: Column) -> Column:
    """Code points that aren't in the longest common subsequence, on both sides."""
    return F.length(a) + F.length(b) - 2 * lcs(a, b)


def as_bytes(c: Column) -> Column:
    """A text with one character for each UTF-8 byte, for kernels that count code points."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def levenshtein_bytes(a: Column, b: Column) -> Column:
    return F.levenshtein(as_bytes(a), as_bytes(b))


def osa_bytes(a: Column, b: Column) -> Column:
    return osa(as_bytes(a), as_bytes(b))


def within(distance: Column, cutoff: int) -> Column:
    """The distance up to a cutoff, null beyond."""
    return F.when(distance <= cutoff, distance)


def osa_within_distance(a: str, b: str, cutoff: int) -> int | None:
    """OSA by a band of ``cutoff`` cells on either side of the diagonal; None beyond the cutoff."""
    if abs(len(a) - len(b)) > cutoff:
        return None
    far = cutoff + 1
    before: list[int] = []
    last = [j if j <= cutoff else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [far] * (len(b) + 1)
        if i <= cutoff:
            row[0] = i
        for j in range(max(1, i - cutoff), min(len(b), i + cutoff) + 1):
            y = b[j - 1]
            best = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row[j] = min(best, far)
        if min(row) > cutoff:
            return None
        before, last = last, row
    return last[-1] if last[-1] <= cutoff else None


def osa_within(a: Column, b: Column, cutoff: int) -> Column:
    return _column(lambda x, y: osa_within_distance(x, y, cutoff), IntegerType())(a, b)


def jaro_winkler_custom(a: Column, b: Column, *, prefix: int = 4, scale: float = 0.1, boost_from: float = 0.0) -> Column:
    """``prefix`` times ``scale`` may not pass 1, so the result stays in [0, 1]."""
    if not 0 <= prefix * scale <= 1 or not 0 <= boost_from <= 1:
        raise ValueError("prefix * scale and boost_from lie in [0, 1]")
    return _batch_column(_jaro_winkler_of(prefix, scale, boost_from), DoubleType())(a, b)
