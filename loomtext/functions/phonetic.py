"""Phonetic keys."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtext.functions.batches import text_udf


def soundex(c: Column) -> Column:
    """Four characters; a text without ASCII letters has the empty key."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def nysiis_key(name: str) -> str:
    """NYSIIS, cut to six letters."""
    w = re.sub("[^A-Z]", "", name.upper())
    if not w:
        return ""
    for old, new in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(old):
            w = new + w[len(old) :]
            break
    for old, new in (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")):
        if w.endswith(old):
            w = w[: -len(old)] + new
            break
    key, i, vowels = w[0], 1, "AEIOU"
    while i < len(w):
        step = 1
        if w.startswith("EV", i):
            new, step = "AF", 2
        elif w[i] in vowels:
            new = "A"
        elif w[i] in "QZM":
            new = {"Q": "G", "Z": "S", "M": "N"}[w[i]]
        elif w.startswith("KN", i):
            new, step = "N", 2
        elif w[i] == "K":
            new = "C"
        elif w.startswith("SCH", i):
            new, step = "SSS", 3
        elif w.startswith("PH", i):
            new, step = "FF", 2
        elif w[i] == "H" and (w[i - 1] not in vowels or (i + 1 < len(w) and w[i + 1] not in vowels)):
            new = key[-1]
        elif w[i] == "W" and w[i - 1] in vowels:
            new = key[-1]
        else:
            new = w[i]
        for ch in new:
            if ch != key[-1]:
                key += ch
        i += step
    if len(key) > 1 and key.endswith("S"):
        key = key[:-1]
    if key.endswith("AY"):
        key = key[:-2] + "Y"
    if len(key) > 1 and key.endswith("A"):
        key = key[:-1]
    return key[:6]


@F.pandas_udf(StringType())
def nysiis(c: pd.Series) -> pd.Series:
    return c.map(nysiis_key, na_action="ignore")


# The classes of the cross-Slavic alphabet, two and three letters first.
_SLAVIC_DIGRAPHS = {"dź": "C", "dż": "C", "dž": "C", "cz": "C", "ch": "C", "sz": "X", "rz": "X", "sh": "X", "zh": "X", "kh": "H"}
_SLAVIC_CLASSES = {
    "P": "pbпб", "F": "fvwфвў", "T": "tdťďþтд", "K": "kqǩк", "H": "hgxħгхґ", "S": "szśźßсз", "Z": "cçѕц", "X": "šžżшжщ", "C": "čćđчђћџѓќ", "M": "mм",
    "N": "nńňñнњ", "L": "lłĺľлљ", "R": "rřр", "J": "jйј", "A": "aáàâäая", "E": "eéèêëеєэ", "I": "iíìîïyиіїы", "O": "oóòôöőоё", "U": "uúùûüůűую", "AN": "ą", "EN": "ę",
}
_SLAVIC_OF = {ch: name for name, letters in _SLAVIC_CLASSES.items() for ch in letters}


def slavic_metaphone_key(text: str, longest: int = 8, with_vowels: bool = False) -> str:
    """Classes of the letters, of either script, without repeats next to each other; vowels only at the front, unless asked for."""
    low, classes, i = text.lower(), "", 0
    while i < len(low):
        pair = _SLAVIC_DIGRAPHS.get(low[i : i + 2])
        classes += pair or _SLAVIC_OF.get(low[i], "")
        i += 2 if pair else 1
    key = ""
    last = ""
    for ch in classes:
        if ch != last and (not key or with_vowels or ch not in "AEIOU"):
            key += ch
        last = ch
    return key[: min(longest, 32)]


def _has(w: str, at: int, *options: str) -> bool:
    return at >= 0 and any(w.startswith(x, at) for x in options)


def double_metaphone_keys(text: str, longest: int = 4) -> tuple[str, str]:
    """Primary and alternate key; equal where a name has one reading."""
    w = re.sub(r"[^A-ZÇÑ]", "", text.upper())
    one, two, i, last = [], [], 0, len(w) - 1
    slavic_german = any(x in w for x in ("W", "K", "CZ", "WITZ"))
    vowel = lambda k: 0 <= k <= last and w[k] in "AEIOUY"

    def add(a: str, b: str | None = None) -> None:
        one.append(a)
        two.append(a if b is None else b)

    if _has(w, 0, "GN", "KN", "PN", "WR", "PS"):
        i = 1
    if _has(w, 0, "X"):
        add("S")
        i = 1
    while i <= last and (len("".join(one)) < longest or len("".join(two)) < longest):
        ch, step = w[i], 1
        if ch in "AEIOUY":
            if i == 0:
                add("A")
        elif ch == "B":
            add("P")
            step = 2 if _has(w, i + 1, "B") else 1
        elif ch == "Ç":
            add("S")
        elif ch == "C":
            if i > 1 and not vowel(i - 2) and _has(w, i - 1, "ACH") and not _has(w, i + 2, "I") and (not _has(w, i + 2, "E") or _has(w, i - 2, "BACHER", "MACHER")):
                add("K")
                step = 2
            elif i == 0 and _has(w, i, "CAESAR"):
                add("S")
                step = 2
            elif _has(w, i, "CHIA"):
                add("K")
                step = 2
            elif _has(w, i, "CH"):
                step = 2
                if i > 0 and _has(w, i, "CHAE"):
                    add("K", "X")
                elif i == 0 and (_has(w, 1, "HARAC", "HARIS") or _has(w, 1, "HOR", "HYM", "HIA", "HEM")) and not _has(w, 0, "CHORE"):
                    add("K")
                elif _has(w, 0, "VAN", "VON", "SCH") or _has(w, i - 2, "ORCHES", "ARCHIT", "ORCHID") or _has(w, i + 2, "T", "S") or ((i == 0 or _has(w, i - 1, "A", "O", "U", "E")) and (i + 2 > last or _has(w, i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W"))):
                    add("K")
                elif i > 0:
                    add("K") if _has(w, 0, "MC") else add("X", "K")
                else:
                    add("X")
            elif _has(w, i, "CZ") and not _has(w, i - 2, "WICZ"):
                add("S", "X")
                step = 2
            elif _has(w, i + 1, "CIA"):
                add("X")
                step = 3
            elif _has(w, i, "CC") and not (i == 1 and w[0] == "M"):
                if _has(w, i + 2, "I", "E", "H") and not _has(w, i + 2, "HU"):
                    add("KS") if (i == 1 and w[0] == "A") or _has(w, i - 1, "UCCEE", "UCCES") else add("X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif _has(w, i, "CK", "CG", "CQ"):
                add("K")
                step = 2
            elif _has(w, i, "CI", "CE", "CY"):
                add("S", "X") if _has(w, i, "CIO", "CIE", "CIA") else add("S")
                step = 2
            else:
                add("K")
                step = 2 if _has(w, i + 1, "C", "K", "Q") and not _has(w, i + 1, "CE", "CI") else 1
        elif ch == "D":
            if _has(w, i, "DG"):
                if _has(w, i + 2, "I", "E", "Y"):
                    add("J")
                    step = 3
                else:
                    add("TK")
                    step = 2
            else:
                add("T")
                step = 2 if _has(w, i, "DT", "DD") else 1
        elif ch == "F":
            add("F")
            step = 2 if _has(w, i + 1, "F") else 1
        elif ch == "G":
            if _has(w, i + 1, "H"):
                step = 2
                if i > 0 and not vowel(i - 1):
                    add("K")
                elif i == 0:
                    add("J") if _has(w, 2, "I") else add("K")
                elif (i > 1 and _has(w, i - 2, "B", "H", "D")) or (i > 2 and _has(w, i - 3, "B", "H", "D")) or (i > 3 and _has(w, i - 4, "B", "H")):
                    pass
                elif i > 2 and w[i - 1] == "U" and _has(w, i - 3, "C", "G", "L", "R", "T"):
                    add("F")
                elif i > 0 and w[i - 1] != "I":
                    add("K")
            elif _has(w, i + 1, "N"):
                step = 2
                if i == 1 and vowel(0) and not slavic_german:
                    add("KN", "N")
                elif not _has(w, i + 2, "EY") and w[i + 1 :] != "Y" and not slavic_german:
                    add("N", "KN")
                else:
                    add("KN")
            elif _has(w, i + 1, "LI") and not slavic_german:
                add("KL", "L")
                step = 2
            elif i == 0 and (_has(w, 1, "Y") or _has(w, 1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                add("K", "J")
                step = 2
            elif _has(w, i + 1, "ER", "Y") and not _has(w, 0, "DANGER", "RANGER", "MANGER") and not _has(w, i - 1, "E", "I") and not _has(w, i - 1, "RGY", "OGY"):
                add("K", "J")
                step = 2
            elif _has(w, i + 1, "E", "I", "Y") or _has(w, i - 1, "AGGI", "OGGI"):
                if _has(w, 0, "VAN", "VON", "SCH") or _has(w, i + 1, "ET"):
                    add("K")
                elif w[i + 1 :] == "IER":
                    add("J")
                else:
                    add("J", "K")
                step = 2
            else:
                add("K")
                step = 2 if _has(w, i + 1, "G") else 1
        elif ch == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                add("H")
                step = 2
        elif ch == "J":
            if _has(w, i, "JOSE") or _has(w, 0, "SAN"):
                add("H") if (i == 0 and len(w) == 4) or _has(w, 0, "SAN") else add("J", "H")
            else:
                if i == 0:
                    add("J", "A")
                elif vowel(i - 1) and not slavic_german and _has(w, i + 1, "A", "O"):
                    add("J", "H")
                elif i == last:
                    add("J", "")
                elif not _has(w, i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not _has(w, i - 1, "S", "K", "L"):
                    add("J")
                step = 2 if _has(w, i + 1, "J") else 1
        elif ch == "K":
            add("K")
            step = 2 if _has(w, i + 1, "K") else 1
        elif ch == "L":
            step = 1
            if _has(w, i + 1, "L"):
                step = 2
                if (i == last - 2 and _has(w, i - 1, "ILLO", "ILLA", "ALLE")) or ((_has(w, last - 1, "AS", "OS") or _has(w, last, "A", "O")) and _has(w, i - 1, "ALLE")):
                    add("L", "")
                else:
                    add("L")
            else:
                add("L")
        elif ch == "M":
            add("M")
            step = 2 if (_has(w, i - 1, "UMB") and (i + 1 == last or _has(w, i + 2, "ER"))) or _has(w, i + 1, "M") else 1
        elif ch in "NÑ":
            add("N")
            step = 2 if _has(w, i + 1, "N") else 1
        elif ch == "P":
            if _has(w, i + 1, "H"):
                add("F")
                step = 2
            else:
                add("P")
                step = 2 if _has(w, i + 1, "P", "B") else 1
        elif ch == "Q":
            add("K")
            step = 2 if _has(w, i + 1, "Q") else 1
        elif ch == "R":
            add("", "R") if i == last and not slavic_german and _has(w, i - 2, "IE") and not _has(w, i - 4, "ME", "MA") else add("R")
            step = 2 if _has(w, i + 1, "R") else 1
        elif ch == "S":
            if _has(w, i - 1, "ISL", "YSL"):
                pass
            elif i == 0 and _has(w, 0, "SUGAR"):
                add("X", "S")
            elif _has(w, i, "SH"):
                add("S") if _has(w, i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else add("X")
                step = 2
            elif _has(w, i, "SIO", "SIA"):
                add("S") if slavic_german else add("S", "X")
                step = 3
            elif (i == 0 and _has(w, 1, "M", "N", "L", "W")) or _has(w, i + 1, "Z"):
                add("S", "X")
                step = 2 if _has(w, i + 1, "Z") else 1
            elif _has(w, i, "SC"):
                step = 3
                if _has(w, i + 2, "H"):
                    if _has(w, i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        add("X", "SK") if _has(w, i + 3, "ER", "EN") else add("SK")
                    else:
                        add("X", "S") if i == 0 and not vowel(3) and not _has(w, 3, "W") else add("X")
                else:
                    add("S") if _has(w, i + 2, "I", "E", "Y") else add("SK")
            else:
                add("", "S") if i == last and _has(w, i - 2, "AI", "OI") else add("S")
                step = 2 if _has(w, i + 1, "S", "Z") else 1
        elif ch == "T":
            if _has(w, i, "TION", "TIA", "TCH"):
                add("X")
                step = 3
            elif _has(w, i, "TH", "TTH"):
                add("T") if _has(w, i + 2, "OM", "AM") or _has(w, 0, "VAN", "VON", "SCH") else add("0", "T")
                step = 2
            else:
                add("T")
                step = 2 if _has(w, i + 1, "T", "D") else 1
        elif ch == "V":
            add("F")
            step = 2 if _has(w, i + 1, "V") else 1
        elif ch == "W":
            if _has(w, i, "WR"):
                add("R")
                step = 2
            else:
                if i == 0 and (vowel(1) or _has(w, 0, "WH")):
                    add("A", "F") if vowel(1) else add("A")
                if (i == last and vowel(i - 1)) or _has(w, i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or _has(w, 0, "SCH"):
                    add("", "F")
                elif _has(w, i, "WICZ", "WITZ"):
                    add("TS", "FX")
                    step = 4
        elif ch == "X":
            if not (i == last and (_has(w, i - 3, "IAU", "EAU") or _has(w, i - 2, "AU", "OU"))):
                add("KS")
            step = 2 if _has(w, i + 1, "C", "X") else 1
        elif ch == "Z":
            if _has(w, i + 1, "H"):
                add("J")
                step = 2
            else:
                add("S", "TS") if _has(w, i + 1, "ZO", "ZI", "ZA") or (slavic_german and i > 0 and w[i - 1] != "T") else add("S")
                step = 2 if _has(w, i + 1, "Z") else 1
        i += step
    return "".join(one)[:longest], "".join(two)[:longest]


_KEY = "struct<primary:string,alternate:string>"


def double_metaphone(c: Column, longest: int = 4) -> Column:
    """struct<primary, alternate>"""

    def apply(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else double_metaphone_keys(x, longest) for x in names], columns=["primary", "alternate"])

    return F.when(c.isNotNull(), F.pandas_udf(apply, _KEY)(c))


def slavic_metaphone(c: Column, longest: int = 8, with_vowels: bool = False) -> Column:
    return text_udf(lambda x: slavic_metaphone_key(x, longest, with_vowels), "string")(c)


#: Column functions from a name to its key.
ENCODERS = {"soundex": soundex, "nysiis": nysiis, "double_metaphone": lambda c: double_metaphone(c)["primary"], "slavic_metaphone": slavic_metaphone}


def matches(a: Column, b: Column, encoder: str = "soundex") -> Column:
    """Whether two names have one key."""
    return ENCODERS[encoder](a) == ENCODERS[encoder](b)


def matches_double_metaphone(a: Column, b: Column, primary_only: bool = False) -> Column:
    """Whether any reading of one is a reading of the other."""
    x, y = double_metaphone(a), double_metaphone(b)
    if primary_only:
        return x["primary"] == y["primary"]
    return F.arrays_overlap(F.array(x["primary"], x["alternate"]), F.array(y["primary"], y["alternate"]))
