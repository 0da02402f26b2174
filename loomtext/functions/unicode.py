"""Unicode normal forms and folding, Arrow-batched where Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtext.functions import strings
from loomtext.functions.segments import word_bounds


def _normal(form: str):
    def apply(c: pd.Series) -> pd.Series:
        return c.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return F.pandas_udf(apply, StringType())


nfc, nfd, nfkc, nfkd = (_normal(f) for f in ("NFC", "NFD", "NFKC", "NFKD"))


def _plain(x: str) -> str:
    return unicodedata.normalize("NFC", "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn"))


@F.pandas_udf(StringType())
def strip_diacritics(c: pd.Series) -> pd.Series:
    return c.map(_plain, na_action="ignore")


@F.pandas_udf(StringType())
def case_fold(c: pd.Series) -> pd.Series:
    return c.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def identifier(c: pd.Series) -> pd.Series:
    """NFKC, folded, without marks."""
    return c.map(lambda x: _plain(unicodedata.normalize("NFKC", x).casefold()), na_action="ignore")


def display_safe(c: Column) -> Column:
    """Without controls (tabs and line ends too), NFC, runs of white space as one blank, at the ends too."""
    return strings.collapse_whitespace(nfc(strings.strip_controls(c)), strip=False)


def search_key(c: Column) -> Column:
    """NFKC, folded, without marks, punctuation plain, white space collapsed and trimmed."""
    return strings.collapse_whitespace(strings.canonicalize_punctuation(identifier(c)))


@F.pandas_udf(StringType())
def simple_case_fold(c: pd.Series) -> pd.Series:
    """Folding that keeps the number of characters: one with a longer folding takes its small letter."""
    fold = lambda ch: f if len(f := ch.casefold()) == 1 else low if len(low := ch.lower()) == 1 else ch
    return c.map(lambda x: "".join(map(fold, x)), na_action="ignore")


def apply_form(c: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD by name."""
    return {"NFC": nfc, "NFD": nfd, "NFKC": nfkc, "NFKD": nfkd}[form](c)


def to_lower(c: Column, locale: str = "") -> Column:
    """Turkish and Azeri know a dotless i; the dot of a capital İ isn't kept as a mark there."""
    if locale.split("-")[0] in ("tr", "az"):
        return F.lower(F.translate(F.replace(c, F.lit("I\u0307"), F.lit("i")), "Iİ", "ıi"))
    return F.lower(c)


def to_upper(c: Column, locale: str = "") -> Column:
    code = locale.split("-")[0]
    if code in ("tr", "az"):
        return F.upper(F.translate(c, "iı", "İI"))
    if code == "lt":  # the dot above a small i with another mark isn't kept
        return F.upper(F.regexp_replace(c, "([ij])\u0307", "$1"))
    if code == "el":  # capitals have no tonos
        return F.translate(F.upper(c), "ΆΈΉΊΌΎΏ", "ΑΕΗΙΟΥΩ")
    return F.upper(c)


def to_title(c: Column, locale: str = "") -> Column:
    """The first letter of each word (of UAX 29) in capitals, the rest small; Dutch words begin with IJ."""
    parts = word_bounds(c)
    dutch = locale.split("-")[0] == "nl"

    def one(w: Column) -> Column:
        plain = F.concat(to_upper(F.substring(w, 1, 1), locale), to_lower(F.substring(w, F.lit(2), F.length(w)), locale))
        return F.when(F.lower(w).startswith("ij"), F.concat(F.lit("IJ"), F.lower(F.substring(w, F.lit(3), F.length(w))))).otherwise(plain) if dutch else plain

    return F.array_join(F.transform(parts, one), "")


def fold(c: Column, mode: str = "full") -> Column:
    """full, simple or turkic."""
    return {"full": case_fold, "simple": simple_case_fold, "turkic": fold_turkic}[mode](c)


def fold_turkic(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def eq_ignore_turkish_case(a: Column, b: Column) -> Column:
    return fold_turkic(a) == fold_turkic(b)
