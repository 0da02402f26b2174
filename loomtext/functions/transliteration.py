"""Transliteration: tables for Cyrillic and Greek, the general reduction to ASCII, and chains of both.

A table maps single characters to texts; what it doesn't have stays. Tables run in the JVM as one ``replace`` for each entry
that yields more than one character, and one ``translate`` for the others.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.batches import text_udf


@dataclass(frozen=True)
class Table:
    """A character table; characters that it maps to longer texts must not be made by others."""

    entries: tuple[tuple[str, str], ...]

    def __call__(self, c: Column) -> Column:
        single = [(a, b) for a, b in self.entries if len(b) == 1]
        gone = "".join(a for a, b in self.entries if not b)
        out = F.translate(c, "".join(a for a, _ in single) + gone, "".join(b for _, b in single))
        for a, b in self.entries:
            if len(b) > 1:
                out = F.replace(out, F.lit(a), F.lit(b))
        return out

    def apply(self, text: str) -> str:
        return text.translate({ord(a): b for a, b in self.entries})


@dataclass(frozen=True)
class Chain:
    steps: tuple

    def __call__(self, c: Column) -> Column:
        for step in self.steps:
            c = step(c)
        return c


def _cased(pairs: str) -> tuple[tuple[str, str], ...]:
    """Entries for both cases from "a:b" pairs in small letters."""
    out = []
    for pair in pairs.split():
        a, b = pair.split(":")
        out.append((a, b))
        if a.upper() != a and len(a.upper()) == 1:
            out.append((a.upper(), b[:1].upper() + b[1:]))
    return tuple(out)


# The ISO 9 table, one Latin letter (with marks) for each Cyrillic one.
ISO9 = Table(_cased("а:a б:b в:v г:g ґ:g̀ д:d ђ:đ е:e ё:ë є:ê ж:ž з:z ѕ:ẑ и:i і:ì ї:ï й:j ј:ǰ к:k л:l љ:l̂ м:m н:n њ:n̂ о:o п:p р:r с:s т:t ћ:ć у:u ў:ŭ ф:f х:h ц:c ч:č џ:d̂ ш:š щ:ŝ ъ:ʺ ы:y ь:ʹ э:è ю:û я:â"))
# Common ASCII spellings of Cyrillic, Greek and special Latin letters.
CYRILLIC_ASCII = Table(_cased("а:a б:b в:v г:g ґ:g д:d ђ:dj е:e ё:e є:ie ж:zh з:z ѕ:dz и:i і:i ї:i й:i ј:j к:k л:l љ:lj м:m н:n њ:nj о:o п:p р:r с:s т:t ћ:c у:u ў:u ф:f х:kh ц:ts ч:ch џ:dz ш:sh щ:shch ъ: ы:y ь: э:e ю:iu я:ia"))
GREEK_ASCII = Table(_cased("α:a β:b γ:g δ:d ε:e ζ:z η:e θ:th ι:i κ:k λ:l μ:m ν:n ξ:x ο:o π:p ρ:r σ:s ς:s τ:t υ:u φ:ph χ:kh ψ:ps ω:o"))
LATIN_ASCII = Table((*_cased("ß:ss æ:ae œ:oe ø:o đ:d ð:d þ:th ł:l ı:i ħ:h ŋ:ng ĸ:k ſ:s"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "...")))

cyrillic_to_latin_iso9 = ISO9


def _ascii(text: str) -> str:
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    for table in (CYRILLIC_ASCII, GREEK_ASCII, LATIN_ASCII):
        plain = table.apply(plain)
    return "".join(ch for ch in plain if ch < "\x80")


def to_ascii(c: Column) -> Column:
    """Marks dropped, known letters spelled out, other characters outside ASCII left out. Plain texts stay in the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), text_udf(_ascii, "string")(c)).otherwise(c)


_SERBIAN = "љ:lj њ:nj џ:dž а:a б:b в:v г:g д:d ђ:đ е:e ж:ž з:z и:i ј:j к:k л:l м:m н:n о:o п:p р:r с:s т:t ћ:ć у:u ф:f х:h ц:c ч:č ш:š"
SERBIAN_LATIN = Table(_cased(_SERBIAN))


def serbian_to_latin(c: Column) -> Column:
    return SERBIAN_LATIN(c)


def serbian_to_cyrillic(c: Column) -> Column:
    """Letter pairs first, in small, title and capital form."""
    pairs = [p.split(":") for p in _SERBIAN.split()]
    for cyrillic, latin in pairs:
        if len(latin) > 1:
            for a, b in ((latin, cyrillic), (latin.title(), cyrillic.upper()), (latin.upper(), cyrillic.upper())):
                c = F.replace(c, F.lit(a), F.lit(b))
    single = [(b, a) for a, b in pairs if len(b) == 1]
    return F.translate(c, "".join(a + a.upper() for a, _ in single), "".join(b + b.upper() for _, b in single))


def contains_cyrillic(c: Column) -> Column:
    return c.rlike(r"\p{IsCyrillic}")


def looks_like_serbian(c: Column) -> Column:
    """Cyrillic with a letter that only Serbian and Macedonian have, or Latin with one of đ, ć, č, š, ž, and no letter of other Slavic alphabets."""
    cyrillic = c.rlike("[ђјљњћџЂЈЉЊЋЏ]") & ~c.rlike("[ѓќѕёыэъіїєґўЃЌЅЁЫЭЪІЇЄҐЎ]")
    latin = c.rlike("[đćĐĆ]") | (c.rlike("[čšžČŠŽ]") & ~c.rlike("[ěřůťďňŕĺľôäąęłńśźżĚŘŮŤĎŇŔĹĽÔÄĄĘŁŃŚŹŻ]"))
    return F.when(contains_cyrillic(c), cyrillic).otherwise(latin)
