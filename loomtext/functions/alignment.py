"""Global and local alignments with affine gaps: a score, and one best script.

A gap of n costs ``gap_open + n * gap_extend``; linear gaps have ``gap_open`` 0. Scripts are steps (op, a, b)
with op keep, replace, delete or insert. A script's table is as large as the product of the lengths;
``align_score`` keeps two rows.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = -(1 << 40)


class Scoring(NamedTuple):
    match: int = 1
    mismatch: int = -1
    gap_open: int = 0
    gap_extend: int = -1


LINEAR, BLAST, AFFINE = Scoring(), Scoring(1, -3, 0, -2), Scoring(1, -1, -1, -1)


def align_score(a: str, b: str, scoring: Scoring = AFFINE, local: bool = False) -> int:
    m, x, o, e = scoring
    edge = lambda n: 0 if local or not n else o + n * e
    last, down = [edge(j) for j in range(len(b) + 1)], [_NONE] * (len(b) + 1)
    best = 0
    for i, p in enumerate(a, 1):
        row, right = [edge(i)], _NONE
        for j, q in enumerate(b, 1):
            down[j] = max(down[j] + e, last[j] + o + e)
            right = max(right + e, row[-1] + o + e)
            s = max(last[j - 1] + (m if p == q else x), down[j], right)
            row.append(max(s, 0) if local else s)
        best, last = max(best, *row), row
    return best if local else last[-1]


def align(a: str, b: str, scoring: Scoring = AFFINE, local: bool = False) -> dict:
    """score, a_start, b_start and script; among ties a pair goes before a deletion, that before an insertion."""
    m, x, o, e = scoring
    n, k = len(a), len(b)
    edge = lambda c: 0 if local or not c else o + c * e
    h = [[edge(j) for j in range(k + 1)]]
    d, r = [[_NONE] * (k + 1)], [[_NONE] + [edge(j) for j in range(1, k + 1)]]
    for i in range(1, n + 1):
        h.append([edge(i)])
        d.append([edge(i)])
        r.append([_NONE])
        for j in range(1, k + 1):
            d[i].append(max(d[i - 1][j] + e, h[i - 1][j] + o + e))
            r[i].append(max(r[i][j - 1] + e, h[i][j - 1] + o + e))
            s = max(h[i - 1][j - 1] + (m if a[i - 1] == b[j - 1] else x), d[i][j], r[i][j])
            h[i].append(max(s, 0) if local else s)
    i, j = max(((i, j) for i in range(n + 1) for j in range(k + 1)), key=lambda c: h[c[0]][c[1]]) if local else (n, k)
    score, script, layer = h[i][j], [], "h"
    while (i or j) and not (local and layer == "h" and h[i][j] == 0):
        if layer == "h":
            pair = m if i and j and a[i - 1] == b[j - 1] else x
            if i and j and h[i][j] == h[i - 1][j - 1] + pair:
                i, j = i - 1, j - 1
                script.append(("keep" if a[i] == b[j] else "replace", a[i], b[j]))
            else:
                layer = "d" if i and h[i][j] == d[i][j] else "r"
        elif layer == "d":
            opened = d[i][j] == h[i - 1][j] + o + e
            i -= 1
            script.append(("delete", a[i], None))
            layer = "h" if opened else "d"
        else:
            opened = r[i][j] == h[i][j - 1] + o + e
            j -= 1
            script.append(("insert", None, b[j]))
            layer = "h" if opened else "r"
    return {"score": score, "a_start": i, "b_start": j, "script": script[::-1]}


_ALIGNMENT = "score int, a_start int, b_start int, script array<struct<op string, a string, b string>>"


def score_column(a: Column, b: Column, scoring: Scoring = AFFINE, local: bool = False) -> Column:
    """The alignment score; null for a null argument."""

    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else align_score(p, q, scoring, local) for p, q in zip(x, y, strict=True)], dtype=object)

    return F.pandas_udf(apply, "int")(a, b)


def align_column(a: Column, b: Column, scoring: Scoring = AFFINE, local: bool = False) -> Column:
    """A struct of score, starts and script; its fields are null for a null argument."""

    def apply(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y, strict=True):
            one = dict.fromkeys(("score", "a_start", "b_start", "script")) if p is None or q is None else align(p, q, scoring, local)
            if one["script"] is not None:
                one["script"] = [{"op": op, "a": s, "b": t} for op, s, t in one["script"]]
            rows.append(one)
        return pd.DataFrame(rows, columns=["score", "a_start", "b_start", "script"], dtype=object)

    return F.pandas_udf(apply, _ALIGNMENT)(a, b)


def extract(script: Column, side: str) -> Column:
    """The aligned slice of one side, "a" or "b"."""
    return F.array_join(F.transform(script, lambda s: s[side]), "")
