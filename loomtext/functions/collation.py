"""Sort keys as string columns: compare or order by the key, then by the text itself.

Root order and locale order with strengths come from Spark's own collations (``collated``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.strings import to_lower_ascii


def collated(c: Column, locale: str = "UNICODE", *, ignore_case: bool = False, ignore_accents: bool = False) -> Column:
    return F.collate(c, locale + "_CI" * ignore_case + "_AI" * ignore_accents)


def ascii_ci_key(c: Column) -> Column:
    return to_lower_ascii(c)


def natural_key(c: Column) -> Column:
    """Digit runs compare by value (length of the run without leading zeros, then its digits), the rest as text."""
    runs = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def piece(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(x)

    return F.array_join(F.transform(runs, piece), "")


def din5007_key(c: Column, variant: int = 1) -> Column:
    """German dictionary order (1: umlauts as their base letters) or phone-book order (2: as base letter and e)."""
    if variant not in (1, 2):
        raise ValueError("variant is 1 or 2")
    out = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    for umlaut, base in (("ä", "a"), ("ö", "o"), ("ü", "u")):
        out = F.replace(out, F.lit(umlaut), F.lit(base + "e" * (variant == 2)))
    return out


def library_key(c: Column, *, ignore_articles: bool = True) -> Column:
    """English catalogue order: no leading article, letters in one case, digits after letters."""
    text = F.lower(c)
    if ignore_articles:
        text = F.regexp_replace(text, r"^(the|an|a)\s+", "")
    # '{' follows z, so a digit behind it sorts after every ASCII letter
    return F.regexp_replace(text, "([0-9])", "{$1")
