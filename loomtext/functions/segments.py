r"""Unicode text segmentation: words, sentences and line breaks by the default rules of UAX 29 and UAX 14.

Graphemes and counts stay in the JVM (``\X``); the other rules run in Arrow batches on character properties of the ``regex``
package. Offsets are code points. Languages that need a dictionary (Thai, Chinese, Japanese) get the default rules: ideographs
are words by themselves.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import strings
from loomtext.functions.batches import text_udf

_BOUNDARY = regex.compile(r"(?V1w)\b")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")
_SPAN = "array<struct<at:int,text:string>>"


def word_bound_list(text: str) -> list[str]:
    """All stretches between word boundaries."""
    return [x for x in _BOUNDARY.split(text) if x]


def word_list(text: str) -> list[str]:
    """The stretches with a letter or a number."""
    return [x for x in word_bound_list(text) if _WORDLIKE.search(x)]


def _placed(parts: list[str]) -> list[tuple[int, str]]:
    out, at = [], 0
    for x in parts:
        out.append((at, x))
        at += len(x)
    return out


_E = r"[\p{SB=Extend}\p{SB=Format}]*"
_PARAGRAPH = r"\r\n|[\p{SB=Sep}\r\n]"
_TERM = regex.compile(rf"(?P<end>{_PARAGRAPH})|(?P<term>[\p{{SB=STerm}}\p{{SB=ATerm}}]){_E}(?P<close>(?:\p{{SB=Close}}{_E})*)(?P<space>(?:\p{{SB=Sp}}{_E})*)(?P<line>{_PARAGRAPH})?")
_CONTINUES = regex.compile(r"[\p{SB=SContinue}\p{SB=STerm}\p{SB=ATerm}]")
_LOWER_NEXT = regex.compile(r"[^\p{SB=OLetter}\p{SB=Upper}\p{SB=Lower}\p{SB=Sep}\r\n\p{SB=STerm}\p{SB=ATerm}]*+\p{SB=Lower}")
_ATERM, _NUMERIC, _UPPER = (regex.compile(rf"\p{{SB={p}}}") for p in ("ATerm", "Numeric", "Upper"))
_CASED_BEFORE = regex.compile(rf"(?<=[\p{{SB=Upper}}\p{{SB=Lower}}]{_E})")


def sentence_list(text: str) -> list[str]:
    """Sentences with the white space that follows them."""
    out, start = [], 0
    for m in _TERM.finditer(text):
        at = m.end()
        if m["term"] and not m["line"] and at < len(text):
            if _CONTINUES.match(text, at):
                continue
            if _ATERM.match(m["term"]):
                if not m["close"] and not m["space"] and (_NUMERIC.match(text, at) or (_UPPER.match(text, at) and _CASED_BEFORE.match(text, m.start()))):
                    continue
                if _LOWER_NEXT.match(text, at):
                    continue
        out.append(text[start:at])
        start = at
    return out + [text[start:]] * (start < len(text))


_CLASSES = "BK CR LF NL SP ZW WJ GL CM ZWJ BA BB HY B2 CB CL CP EX IN NS OP QU IS NU PO PR SY AI AL CJ EB EM H2 H3 HL ID JL JV JT RI SA XX SG".split()
_OF = [(c, regex.compile(rf"\p{{lb={c}}}")) for c in _CLASSES]


@lru_cache(maxsize=1 << 16)
def _line_class(ch: str) -> str:
    found = next((c for c, p in _OF if p.match(ch)), "AL")
    if found in ("AI", "SG", "XX"):
        return "AL"
    if found == "SA":
        return "CM" if regex.match(r"[\p{Mn}\p{Mc}]", ch) else "AL"
    return "NS" if found == "CJ" else found


_HANGUL = {"JL": {"JL", "JV", "H2", "H3"}, "JV": {"JV", "JT"}, "H2": {"JV", "JT"}, "JT": {"JT"}, "H3": {"JT"}}
_NEVER_BEFORE = {"CL", "CP", "EX", "IS", "SY"}
_NUMBERS = {("CL", "PO"), ("CP", "PO"), ("CL", "PR"), ("CP", "PR"), ("NU", "PO"), ("NU", "PR"), ("PO", "OP"), ("PO", "NU"), ("PR", "OP"), ("PR", "NU"), ("HY", "NU"), ("IS", "NU"), ("NU", "NU"), ("SY", "NU")}


def _may_break(base: str, after: str, spaces: bool, flags: int, lead: str) -> bool:
    """The rules from LB11 on: ``base`` is the class before any ``spaces``, ``lead`` the one before it, ``flags`` the regional indicators at the end."""
    if after == "WJ" or (base in ("WJ", "GL") and not spaces) or (after == "GL" and not spaces and base not in ("BA", "HY")):
        return False
    if after in _NEVER_BEFORE or base == "OP" or (base == "QU" and after == "OP") or (base in ("CL", "CP") and after == "NS") or (base == "B2" and after == "B2"):
        return False
    if spaces:
        return True
    if "QU" in (base, after):
        return False
    if "CB" in (base, after):
        return True
    if after in ("BA", "HY", "NS", "IN") or base == "BB" or (lead == "HL" and base in ("HY", "BA")) or (base == "SY" and after == "HL"):
        return False
    letters, picture = ("AL", "HL"), ("ID", "EB", "EM")
    if (base in letters and after in ("NU", "PR", "PO", "OP", *letters)) or (base in ("NU", "PR", "PO", "IS", "CP") and after in letters):
        return False
    if (base == "PR" and after in picture) or (base in picture and after == "PO") or (base, after) in _NUMBERS or (base == "NU" and after == "OP") or (base == "CP" and after == "NU"):
        return False
    if after in _HANGUL.get(base, ()) or (base in _HANGUL and after == "PO") or (base == "PR" and after in _HANGUL):
        return False
    if base == "RI" and after == "RI":
        return flags % 2 == 0
    return not (base == "EB" and after == "EM")


def line_break_list(text: str) -> list[tuple[int, bool]]:
    """(offset after which a line may end, whether it must) in order; the end of the text is the last."""
    out: list[tuple[int, bool]] = []
    raw = [_line_class(ch) for ch in text]
    base, lead, flags = "", "", 0  # classes before this place, spaces left out
    for i, c in enumerate(raw):
        previous = raw[i - 1] if i else ""
        hard = previous in ("BK", "LF", "NL") or (previous == "CR" and c != "LF")
        if hard:
            out.append((i, True))
            base, lead, flags, previous = "", "", 0, ""
        if c in ("BK", "CR", "LF", "NL", "SP", "ZW"):
            if c == "ZW":
                base = "ZW"
            continue
        spaces = previous == "SP"
        if c in ("CM", "ZWJ"):
            if base and base != "ZW" and not spaces:
                continue  # a mark is of the class of what it is on
            c = "AL"
        if base == "ZW" or (spaces and not base) or (base and previous != "ZWJ" and _may_break(base, c, spaces, flags, lead)):
            out.append((i, False))
        flags = flags + 1 if c == "RI" and not spaces else int(c == "RI")
        lead, base = "" if spaces else base, c
    return out + [(len(text), False)] * bool(text)


def words(c: Column) -> Column:
    """array<string>"""
    return text_udf(word_list, "array<string>")(c)


def word_bounds(c: Column) -> Column:
    return text_udf(word_bound_list, "array<string>")(c)


def word_indices(c: Column) -> Column:
    """array<struct<at, text>>"""
    return text_udf(lambda x: [{"at": a, "text": w} for a, w in _placed(word_bound_list(x)) if _WORDLIKE.search(w)], _SPAN)(c)


def word_bound_indices(c: Column) -> Column:
    return text_udf(lambda x: [{"at": a, "text": w} for a, w in _placed(word_bound_list(x))], _SPAN)(c)


def sentences(c: Column) -> Column:
    return text_udf(sentence_list, "array<string>")(c)


def sentence_indices(c: Column) -> Column:
    return text_udf(lambda x: [{"at": a, "text": s} for a, s in _placed(sentence_list(x))], _SPAN)(c)


def line_breaks(c: Column) -> Column:
    """array<struct<at, must>>"""
    return text_udf(lambda x: [{"at": a, "must": m} for a, m in line_break_list(x)], "array<struct<at:int,must:boolean>>")(c)


def _cut(text: str) -> list[str]:
    ends = [0, *(a for a, _ in line_break_list(text))]
    return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def line_segments(c: Column) -> Column:
    """The stretches between places where a line may end."""
    return text_udf(_cut, "array<string>")(c)


#: By unit; "bytes" are whole characters, as code points are.
UNITS = {"bytes": lambda c: F.split(c, ""), "code_points": lambda c: F.split(c, ""), "graphemes": strings.graphemes, "words": word_bounds, "sentences": sentences, "lines": strings.split_lines, "line_segments": line_segments}


def segment(c: Column, unit: str) -> Column:
    """array<string> by one of ``UNITS``; the empty text has none."""
    return F.filter(UNITS[unit](c), lambda x: x != "") if unit != "lines" else UNITS[unit](c)


def segments_with_offsets(c: Column, unit: str) -> Column:
    """array<struct<at, text>> for units whose segments make up the whole text."""
    if unit == "lines":
        raise ValueError("lines leave their ends out, so they have no offsets")
    return text_udf(lambda parts: [{"at": a, "text": x} for a, x in _placed(list(parts))], _SPAN)(segment(c, unit))


def whitespace_tokens(c: Column) -> Column:
    """array<struct<at, text>> of the runs without white space."""
    return text_udf(lambda x: [{"at": m.start(), "text": m[0]} for m in regex.finditer(r"\P{White_Space}+", x)], _SPAN)(c)


def delimiter_tokens(c: Column, delimiter: str) -> Column:
    """array<struct<at, text>> of what lies between delimiters, empty parts left out."""
    return text_udf(lambda x: [{"at": a, "text": p} for a, p in _placed([y for part in x.split(delimiter) for y in (part, delimiter)][:-1])[::2] if p], _SPAN)(c)


def alphanumeric_tokens(c: Column) -> Column:
    """The maximal runs of letters and numbers."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
