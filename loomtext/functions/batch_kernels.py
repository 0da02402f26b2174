"""Dynamic programmes over a whole Arrow batch: one matrix row of all pairs at a time.

Pairs are dealt into blocks of similar length with at most ``CELLS`` matrix cells (one pair at least). In a row, what a cell takes from the cell before it
is a running minimum (or maximum) over what the cells take from the rows above, shifted by the gap; so a row is a few
array operations for all pairs of a block. Code points are padded with values that equal nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

CELLS = 1 << 22


def _padded(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), pad, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, size


def _blocks(a: list[str], b: list[str]) -> Iterator[list[int]]:
    order = sorted(range(len(a)), key=lambda i: max(len(a[i]), len(b[i])))
    block: list[int] = []
    n = m = 0
    for i in order:
        n, m = max(n, len(a[i]) + 2), max(m, len(b[i]) + 2)
        if block and (len(block) + 1) * n * m > CELLS:
            yield block
            block, n, m = [], len(a[i]) + 2, len(b[i]) + 2
        block.append(i)
    if block:
        yield block


def batched(kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind) -> Callable[[list[str], list[str]], np.ndarray]:
    """A function of two lists of texts from a kernel of (letters, lengths) of both sides."""

    def run(a: list[str], b: list[str]) -> np.ndarray:
        out = np.zeros(len(a), kind)
        for block in _blocks(a, b):
            x, n = _padded([a[i] for i in block], -1)
            y, m = _padded([b[i] for i in block], -2)
            out[block] = kernel(x, n, y, m)
        return out

    return run


def _picked(out: np.ndarray, row: np.ndarray, i: int, n: np.ndarray, m: np.ndarray) -> None:
    """Takes the last cell of the pairs whose left side ends at row ``i``."""
    done = np.flatnonzero(n == i)
    out[done] = row[done, m[done]]


def _filled(t: np.ndarray, step: int) -> np.ndarray:
    """Each cell at least what a cell before it costs, with ``step`` for each place between."""
    shift = step * np.arange(t.shape[1])
    return np.minimum.accumulate(t - shift, axis=1) + shift


def osa(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    out, width = np.zeros(len(x), np.int64), y.shape[1]
    last = np.broadcast_to(np.arange(width + 1), (len(x), width + 1)).copy()
    before = last
    _picked(out, last, 0, n, m)
    for i in range(1, x.shape[1] + 1):
        t = last + 1
        t[:, 1:] = np.minimum(t[:, 1:], last[:, :-1] + (x[:, i - 1 : i] != y))
        if i > 1 and width > 1:
            swap = (x[:, i - 1 : i] == y[:, :-1]) & (x[:, i - 2 : i - 1] == y[:, 1:])
            t[:, 2:] = np.where(swap, np.minimum(t[:, 2:], before[:, :-2] + 1), t[:, 2:])
        before, last = last, _filled(t, 1)
        _picked(out, last, i, n, m)
    return out


def damerau(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Unrestricted: a letter may be swapped with the last equal one on the other side, with edits between."""
    pairs, width = len(x), y.shape[1]
    out = np.zeros(pairs, np.int64)
    rows = np.zeros((x.shape[1] + 1, pairs, width + 1), np.int32)
    rows[0] = np.arange(width + 1)
    _picked(out, rows[0], 0, n, m)
    seen = np.zeros((pairs, width), np.int64)  # the last row, counted from 1, whose letter is this column's
    columns, who = np.arange(1, width + 1), np.arange(pairs)[:, None]
    for i in range(1, x.shape[1] + 1):
        same = x[:, i - 1 : i] == y
        t = rows[i - 1] + 1
        t[:, 1:] = np.minimum(t[:, 1:], rows[i - 1][:, :-1] + ~same)
        left = np.maximum.accumulate(np.where(same, columns, 0), axis=1)
        left = np.concatenate((np.zeros((pairs, 1), np.int64), left[:, :-1]), axis=1)  # the last column before with this row's letter
        both = (seen > 0) & (left > 0)
        swap = rows[np.maximum(seen - 1, 0), who, np.maximum(left - 1, 0)] + (i - seen - 1) + 1 + (columns - left - 1)
        t[:, 1:] = np.where(both, np.minimum(t[:, 1:], swap), t[:, 1:])
        rows[i] = _filled(t, 1)
        seen[same] = i
        _picked(out, rows[i], i, n, m)
    return out


def lcs(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    last = np.zeros((len(x), y.shape[1] + 1), np.int64)
    for i in range(1, x.shape[1] + 1):
        t = last.copy()
        t[:, 1:] = np.maximum(t[:, 1:], last[:, :-1] + (x[:, i - 1 : i] == y))
        last = np.maximum.accumulate(t, axis=1)
        _picked(out, last, i, n, m)
    return out


def _aligned(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, match: int, mismatch: int, gap: int, local: bool) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    last = np.broadcast_to(np.arange(y.shape[1] + 1) * (0 if local else gap), (len(x), y.shape[1] + 1)).copy()
    if not local:
        _picked(out, last, 0, n, m)
    for i in range(1, x.shape[1] + 1):
        t = last + gap
        t[:, 1:] = np.maximum(t[:, 1:], last[:, :-1] + np.where(x[:, i - 1 : i] == y, match, mismatch))
        if local:
            t = np.maximum(t, 0)
        last = -_filled(-t, -gap)
        if local:  # what lies past a text's end only loses
            out = np.maximum(out, last.max(axis=1))
        else:
            _picked(out, last, i, n, m)
    return out


def needleman_wunsch(match: int = 1, mismatch: int = -1, gap: int = -1):
    return lambda x, n, y, m: _aligned(x, n, y, m, match, mismatch, gap, False)


def smith_waterman(match: int = 1, mismatch: int = -1, gap: int = -1):
    """Gaps and mismatches must cost something, else text past an end could add to a score."""
    return lambda x, n, y, m: _aligned(x, n, y, m, match, mismatch, gap, True)


def jaro(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    pairs, width = len(x), y.shape[1]
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    columns = np.arange(width)
    taken = np.zeros((pairs, width), bool)
    found = np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        free = (x[:, i : i + 1] == y) & ~taken & (columns >= i - reach) & (columns <= i + reach)
        hit = free.any(axis=1) if width else np.zeros(pairs, bool)
        found[:, i] = hit
        who = np.flatnonzero(hit)
        taken[who, free[who].argmax(axis=1)] = True
    count = found.sum(axis=1)
    # matched letters of both sides in their order, in front
    most = int(count.max(initial=0))
    one = np.take_along_axis(x, np.argsort(~found, axis=1, kind="stable")[:, :most], axis=1)
    two = np.take_along_axis(y, np.argsort(~taken, axis=1, kind="stable")[:, :most], axis=1)
    swaps = ((one != two) & (np.arange(most) < count[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (count / n + count / m + (count - swaps) / count) / 3
    return np.where((n == 0) & (m == 0), 1.0, np.where(count == 0, 0.0, value))
