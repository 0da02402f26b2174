"""Language detection in tiers: by script where one has a single language, else by stop words.

The word model scores a language by the share of a text's words that are its stop words; shared words count for each. The
confidence is the best score's part of the sum of the best two. It needs no data beyond the packs, but short texts without
function words are undecided (null). Trained models can be put in as further tiers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.batches import text_udf
from loomtext.functions.strings import classify_script
from loomtext.languages.stop_words import WORDS

DETECTION = "struct<language:string,confidence:double>"
#: Scripts that decide the language alone.
BY_SCRIPT = {"Jpan": "ja", "Hang": "ko", "Thai": "th", "Grek": "el", "Hebr": "he", "Armn": "hy", "Geor": "ka", "Taml": "ta", "Mlym": "ml", "Guru": "pa", "Beng": "bn", "Ethi": "am", "Hani": "zh"}
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=64)
def _languages_of(langs: tuple[str, ...]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, code in enumerate(langs):
        for word in set(WORDS[code].split()):
            out.setdefault(word, []).append(k)
    return out


def ranked(text: str, langs: tuple[str, ...]) -> list[tuple[str, float]]:
    """(language, share of the words), best first, ties by code; without those that no word speaks for."""
    table, counts, words = _languages_of(langs), [0] * len(langs), _WORD.findall(text.lower())
    for w in words:
        for k in table.get(w, ()):
            counts[k] += 1
    found = [(code, n / len(words)) for code, n in zip(langs, counts, strict=True) if n]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def _decided(found: list[tuple[str, float]]) -> tuple[str | None, float | None]:
    if not found:
        return None, None
    second = found[1][1] if len(found) > 1 else 0.0
    return found[0][0], found[0][1] / (found[0][1] + second)


def _known(langs: list[str] | None) -> tuple[str, ...]:
    return tuple(sorted(code for code in (langs if langs is not None else WORDS) if code in WORDS))


def detect_words(c: Column, langs: list[str] | None = None) -> Column:
    """struct<language, confidence> among ``langs`` (all packs with a list); null where no word decides."""
    among = _known(langs)

    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else _decided(ranked(x, among)) for x in texts], columns=["language", "confidence"])

    out = F.pandas_udf(apply, DETECTION)(c)
    return F.when(out["language"].isNotNull(), out)


def detect_from(c: Column, langs: list[str]) -> Column:
    """Null where none of ``langs`` is known."""
    return detect_words(c, langs) if _known(langs) else F.lit(None).cast(DETECTION)


def detect_ranked(c: Column, langs: list[str] | None = None, most: int = 5) -> Column:
    """array<struct<language, confidence>> of the best languages with their shares."""
    among = _known(langs)
    return text_udf(lambda x: [{"language": a, "confidence": b} for a, b in ranked(x, among)[:most]], f"array<{DETECTION}>")(c)


def confidence_of(c: Column, lang: str, langs: list[str] | None = None) -> Column:
    """The share of the words that speak for one language, 0 for none; null for an unknown one."""
    among = _known([lang, *(langs or [])])
    if lang not in among:
        return F.lit(None).cast("double")
    return text_udf(lambda x: dict(ranked(x, among)).get(lang, 0.0), "double")(c)


def detect_by_script(c: Column) -> Column:
    """struct<language, confidence> for scripts of one language, else null."""
    table = F.create_map(*[F.lit(x) for pair in BY_SCRIPT.items() for x in pair])
    code = table[classify_script(c)]
    return F.when(code.isNotNull(), F.struct(code.alias("language"), F.lit(1.0).alias("confidence")))


def detect(c: Column, langs: list[str] | None = None, further: list[Callable[[Column], Column]] = (), least: float = 0.75) -> Column:
    """The script's language, else the word model's; ``further`` tiers answer where it is less sure than ``least``, in turn."""
    words = detect_words(c, langs)
    out = F.when(words["confidence"] >= least, words)
    for tier in further:
        out = F.coalesce(out, tier(c))
    return F.coalesce(detect_by_script(c), out, words)
