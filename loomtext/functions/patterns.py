r"""Patterns as values: literal, wildcard, glob and regular expression, with one set of operations.

A ``Pattern`` is a regular expression for Spark's (Java's) engine, so all operations but offsets stay in the JVM. Patterns match
by code point; ``bytes_only`` restricts classes such as ``\w`` to ASCII. Look-around and back-references are refused, since
an engine of linear time has none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.batches import text_udf
from loomtext.functions.strings import _quoted


@dataclass(frozen=True)
class Pattern:
    """``regex`` is unanchored; ``whole`` patterns match the whole text only."""

    regex: str
    whole: bool = False

    def _searched(self) -> str:
        return rf"\A(?:{self.regex})\z" if self.whole else self.regex

    def is_match(self, c: Column) -> Column:
        return c.rlike(self._searched())

    def find(self, c: Column) -> Column:
        """struct<start, end, text> of the first match in code points, null without one."""
        at = F.regexp_instr(c, F.lit(self._searched()))
        hit = F.regexp_substr(c, F.lit(self._searched()))
        return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(hit)).alias("end"), hit.alias("text")))

    def find_iter(self, c: Column) -> Column:
        """The texts of all matches that don't overlap, in order."""
        return F.regexp_extract_all(c, F.lit(self._searched()), F.lit(0))

    def find_spans(self, c: Column) -> Column:
        """array<struct<start, end, text>> of ``find_iter``: each gap and match in turn, summed up."""
        between, hits = F.split(c, self._searched()), self.find_iter(c)
        pieces = F.filter(F.flatten(F.transform(F.arrays_zip(between.alias("a"), hits.alias("b")), lambda z: F.array(z["a"], z["b"]))), lambda x: x.isNotNull())

        def spans(parts: list[str]) -> list[tuple[int, int, str]]:
            out, at = [], 0
            for i, part in enumerate(parts):
                if i % 2:
                    out.append((at, at + len(part), part))
                at += len(part)
            return [{"start": s, "end": e, "text": x} for s, e, x in out]

        return text_udf(spans, "array<struct<start:int,end:int,text:string>>")(pieces)

    def replace_all(self, c: Column, replacement: str) -> Column:
        """The replacement is literal."""
        return F.regexp_replace(c, self._searched(), replacement.replace("\\", "\\\\").replace("$", "\\$"))

    def split(self, c: Column) -> Column:
        """Empty parts stay, at the ends too."""
        return F.split(c, self._searched())


def literal(text: str) -> Pattern:
    return Pattern(_quoted(text))


def wildcard(pattern: str, *, anywhere: bool = False) -> Pattern:
    """``*`` any run, ``?`` one code point, all else literal."""
    body = "".join(".*" if p == "*" else "." if p == "?" else _quoted(p) for p in pattern)
    return Pattern(f"(?s:{body})", whole=not anywhere)


_GLOB = re.compile(r"\\(.)|(\*)|(\?)|\[([!^]?)(\]?[^\]]*)\]|(.)", re.DOTALL)


def _glob_class(negated: str, body: str) -> str:
    body = re.sub(r"\\(.)", r"\1", body)
    return f"[{'^' if negated else ''}" + "".join("\\" + ch if ch in r"\[]^&~" else ch for ch in body) + "]"


def glob(pattern: str, *, anywhere: bool = False) -> Pattern:
    r"""A wildcard with classes: ``[abc]``, ``[a-z]``, ``[!a]`` or ``[^a]``, and ``\`` before a literal mark."""
    out = []
    for m in _GLOB.finditer(pattern):
        escaped, star, one, negated, body, plain = m.groups()
        out.append(".*" if star else "." if one else _glob_class(negated, body) if body is not None else _quoted(escaped or plain))
    return Pattern(f"(?s:{''.join(out)})", whole=not anywhere)


_REFUSED = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<)|[+*?}]\+")


def regex(pattern: str, *, ignore_case: bool = False, bytes_only: bool = False) -> Pattern:
    """Raises ValueError for a pattern that doesn't compile or that needs an engine with backtracking."""
    if _REFUSED.search(pattern):
        raise ValueError("look-around, atomic groups and back-references aren't supported")
    try:
        re.compile(re.sub(r"\\[pPXRhHvV](\{[^}]*\}|.)?|\\[zZG]|\[:[a-z]+:\]", "a", pattern))
    except re.error as e:
        raise ValueError(f"not a regular expression: {e}") from e
    flags = ("i" if ignore_case else "") + ("" if bytes_only else "uU")
    return Pattern(f"(?{flags}:{pattern})" if flags else f"(?:{pattern})")


class MultiPattern:
    """An Aho-Corasick automaton of many literal patterns, built once in each worker."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = list(patterns)
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns, "_automaton": None}

    def places(self, text: str) -> list[tuple[int, int]]:
        """(position, pattern number) of all matches, overlapping ones too, sorted. An empty pattern is once at 0."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, p in enumerate(self.patterns):
                if p:
                    self._automaton.add_word(p, [*self._automaton.get(p, []), i])
            self._automaton.make_automaton()
        found = [(0, i) for i, p in enumerate(self.patterns) if not p]
        if len(self._automaton):
            found += [(end + 1 - len(self.patterns[i]), i) for end, numbers in self._automaton.iter(text) for i in numbers]
        return sorted(found)

    def find_all(self, c: Column) -> Column:
        """array<struct<position, pattern_index>>"""
        return text_udf(lambda x: [{"position": p, "pattern_index": i} for p, i in self.places(x)], "array<struct<position:int,pattern_index:int>>")(c)

    def is_match(self, c: Column) -> Column:
        hit = F.lit(False)
        for p in self.patterns:
            hit = hit | F.contains(c, F.lit(p))
        return hit
