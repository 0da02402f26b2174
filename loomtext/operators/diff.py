"""Line and word diffs as edit scripts, unified text and patches."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomtext.functions.batches import pair_udf
from loomtext.functions.segments import word_bound_list

SCRIPT = ArrayType(StructType([StructField("op", StringType()), StructField("value", StringType())]))


def myers(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """A shortest script of keep, delete and insert."""
    n, m = len(a), len(b)
    far, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            far[k] = x
            if x >= n and y >= m:
                return _walk_back(a, b, trace)
    return []


def _walk_back(a: list[str], b: list[str], trace: list[dict[int, int]]) -> list[tuple[str, str]]:
    x, y, out = len(a), len(b), []
    for d in range(len(trace) - 1, -1, -1):
        far, k = trace[d], x - y
        before = k + 1 if k == -d or (k != d and far[k - 1] < far[k + 1]) else k - 1
        px = far[before]
        py = px - before
        while x > px and y > py and x and y:
            x, y = x - 1, y - 1
            out.append(("keep", a[x]))
        if d:
            out.append(("insert", b[py]) if x == px else ("delete", a[px]))
        x, y = px, py
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Anchored on the elements that both sides have once, in their longest common order; what lies between is diffed the same way, at last by ``myers``."""
    out: list[tuple[str, str]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        if isinstance(i, str):  # an element kept between two stretches
            out.append((i, n))
            continue
        start = i
        while i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        out += [("keep", x) for x in a[start:i]]
        same = 0
        while same < min(n - i, m - j) and a[n - 1 - same] == b[m - 1 - same]:
            same += 1
        tail = [("keep", x, None, None) for x in reversed(a[n - same : n])]
        n, m = n - same, m - same
        todo += tail
        once = _once(a, i, n)
        pairs = [(once[x], k) for x, k in _once(b, j, m).items() if x in once]
        anchors = _rising(sorted(pairs))
        if not anchors:
            todo += [(op, x, None, None) for op, x in reversed(myers(a[i:n], b[j:m]))]
            continue
        # the last stretch is put down first, so that the first comes up next
        ends = [*anchors, (n, m)]
        starts = [(i, j), *((p + 1, q + 1) for p, q in anchors)]
        for k in range(len(ends) - 1, -1, -1):
            if k < len(anchors):
                todo.append(("keep", a[anchors[k][0]], None, None))
            todo.append((*_span(starts[k], ends[k]),))
    return out


def _span(start: tuple[int, int], end: tuple[int, int]) -> tuple[int, int, int, int]:
    return start[0], end[0], start[1], end[1]


def _once(x: list[str], start: int, end: int) -> dict[str, int]:
    """Elements that occur once in a stretch, with their places."""
    seen: dict[str, int] = {}
    for k in range(start, end):
        seen[x[k]] = -1 if x[k] in seen else k
    return {v: k for v, k in seen.items() if k >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises on both sides; they come sorted by the first."""
    tops: list[int] = []  # second places that end runs of each length
    at: list[int] = []
    before: list[int] = []
    for k, (_, q) in enumerate(pairs):
        n = bisect_left(tops, q)
        before.append(at[n - 1] if n else -1)
        if n == len(tops):
            tops.append(q)
            at.append(k)
        else:
            tops[n], at[n] = q, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def collapse_adjacent(script: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """In each run of changes, deletions before insertions."""
    out: list[tuple[str, str]] = []
    run: list[tuple[str, str]] = []
    for op, x in [*script, ("keep", "")]:
        if op == "keep":
            out += sorted(run, key=lambda e: e[0] == "insert")
            run = []
            out.append((op, x))
        else:
            run.append((op, x))
    return out[:-1]


def hunks(script: list[tuple[str, str]], context: int = 3) -> list[dict]:
    """Changes with ``context`` kept elements around; regions join when at most twice that lies between. Starts count from 0."""
    changed = [k for k, (op, _) in enumerate(script) if op != "keep"]
    groups: list[list[int]] = []
    for k in changed:
        if groups and k - groups[-1][1] - 1 <= 2 * context:
            groups[-1][1] = k
        else:
            groups.append([k, k])
    olds, news = [0], [0]
    for op, _ in script:
        olds.append(olds[-1] + (op != "insert"))
        news.append(news[-1] + (op != "delete"))
    out = []
    for first, last in groups:
        a, b = max(0, first - context), min(len(script), last + 1 + context)
        out.append({"old_start": olds[a], "old_len": olds[b] - olds[a], "new_start": news[a], "new_len": news[b] - news[a], "edits": script[a:b]})
    return out


def write_unified(script: list[tuple[str, str]], context: int = 3, old: str = "a", new: str = "b") -> str:
    """Unified text of a script of lines with their ends; empty when nothing changed."""
    parts = []
    for h in hunks(script, context):
        place = lambda s, n: f"{s + (n > 0)}" + (f",{n}" if n != 1 else "")
        parts.append(f"@@ -{place(h['old_start'], h['old_len'])} +{place(h['new_start'], h['new_len'])} @@\n")
        for op, x in h["edits"]:
            parts.append({"keep": " ", "delete": "-", "insert": "+"}[op] + x + ("" if x.endswith("\n") else "\n\\ No newline at end of file\n"))
    return f"--- {old}\n+++ {new}\n" + "".join(parts) if parts else ""


def parse_unified(patch: str) -> list[dict] | None:
    """The hunks of unified text, null for a broken one."""
    out: list[dict] = []
    rows = patch.splitlines(True)
    k = 0
    while k < len(rows):
        m = _HUNK.match(rows[k])
        k += 1
        if not m:
            continue
        want_old, want_new = (int(m[g] if m[g] is not None else 1) for g in (2, 4))
        hunk = {"old_start": int(m[1]) - (want_old > 0), "old_len": want_old, "new_start": int(m[3]) - (want_new > 0), "new_len": want_new, "edits": []}
        while want_old or want_new:
            if k >= len(rows) or rows[k][:1] not in (" ", "-", "+"):
                return None
            op = {" ": "keep", "-": "delete", "+": "insert"}[rows[k][0]]
            want_old -= op != "insert"
            want_new -= op != "delete"
            hunk["edits"].append((op, rows[k][1:]))
            k += 1
            if k < len(rows) and rows[k].startswith("\\"):
                hunk["edits"][-1] = (op, hunk["edits"][-1][1].removesuffix("\n"))
                k += 1
        if want_old < 0 or want_new < 0:
            return None
        out.append(hunk)
    return out


def apply_hunks(text: str, found: list[dict]) -> str | None:
    """The changed text, null if a hunk doesn't fit."""
    lines, out, at = text.splitlines(True), [], 0
    for h in found:
        if h["old_start"] < at or h["old_start"] > len(lines):
            return None
        out += lines[at : h["old_start"]]
        at = h["old_start"]
        for op, x in h["edits"]:
            if op != "insert":
                if at >= len(lines) or lines[at] != x:
                    return None
                at += 1
            if op != "delete":
                out.append(x)
    return "".join(out + lines[at:])


def unified(a: str, b: str, context: int = 3) -> str:
    return "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), "a", "b", n=context))


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def apply_unified(text: str, patch: str) -> str | None:
    """The patched text, null if the patch is broken or doesn't fit."""
    found = parse_unified(patch)
    return None if found is None else apply_hunks(text, found)


ALGORITHMS = {"myers": myers, "patience": patience}
#: How a text is cut; words are the stretches between word boundaries.
DIFF_UNITS = {"lines": lambda x: x.splitlines(True), "words": word_bound_list, "characters": list}


def diff_at(a: Column, b: Column, unit: str = "lines", algorithm: str = "myers") -> Column:
    """array<struct<op, value>> of keep, delete and insert."""
    cut, of = DIFF_UNITS[unit], ALGORITHMS[algorithm]
    return pair_udf(lambda x, y: [{"op": o, "value": v} for o, v in of(cut(x), cut(y))], "array<struct<op:string,value:string>>")(a, b)


def diff_lines_unified(a: Column, b: Column, context: int = 3, algorithm: str = "myers") -> Column:
    """Unified text; empty for equal texts."""
    return pair_udf(lambda x, y: write_unified(collapse_adjacent(ALGORITHMS[algorithm](x.splitlines(True), y.splitlines(True))), context), "string")(a, b)


def patched(text: Column, patch: Column) -> Column:
    """The text after a unified patch, null where it doesn't fit."""
    return pair_udf(apply_unified, "string")(text, patch)


@F.pandas_udf(SCRIPT)
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [{"op": o, "value": v} for o, v in myers(x.splitlines(), y.splitlines())] for x, y in zip(a, b, strict=True)])


@F.pandas_udf(SCRIPT)
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [{"op": o, "value": v} for o, v in myers(x.split(), y.split())] for x, y in zip(a, b, strict=True)])
