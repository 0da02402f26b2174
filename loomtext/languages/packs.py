"""Language packs: a registry of codes, names, scripts, stop words, tokenizers and stemmers.

A pack is looked up by its code or by a longer tag such as ``pt-BR``, whose last parts are dropped until one is known. Users
add packs of their own with ``register``. Stop words compare without the case of ASCII letters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.batches import text_udf
from loomtext.functions.segments import alphanumeric_tokens, words
from loomtext.languages import stemmers
from loomtext.languages.stop_words import WORDS

Tokenize = Callable[[Column], Column]


@dataclass(frozen=True)
class Language:
    code: str
    name: str
    script: str
    stem: Callable[[str], str] | None = None
    tokenize: Tokenize = alphanumeric_tokens
    stop_words: tuple[str, ...] | None = None


# Codes, English names and scripts.
_NAMES = """am Amharic Ethi|ar Arabic Arab|be Belarusian Cyrl|bg Bulgarian Cyrl|bn Bengali Beng|cs Czech Latn|da Danish Latn|de German Latn
el Greek Grek|en English Latn|es Spanish Latn|et Estonian Latn|fa Persian Arab|fi Finnish Latn|fr French Latn|he Hebrew Hebr
hi Hindi Deva|hu Hungarian Latn|hy Armenian Armn|id Indonesian Latn|is Icelandic Latn|it Italian Latn|ja Japanese Jpan|ka Georgian Geor
ko Korean Kore|mk Macedonian Cyrl|ml Malayalam Mlym|mr Marathi Deva|nl Dutch Latn|nn Norwegian_Nynorsk Latn|no Norwegian Latn|pa Punjabi Guru
pl Polish Latn|pt Portuguese Latn|ro Romanian Latn|ru Russian Cyrl|sk Slovak Latn|sr Serbian Cyrl|sv Swedish Latn|ta Tamil Taml
th Thai Thai|tr Turkish Latn|uk Ukrainian Cyrl|vi Vietnamese Latn|zh Chinese Hans"""

#: Scripts written without blanks are cut at the default word boundaries, those with marks on their letters too.
_BY_BOUNDARY = {"Jpan", "Hans", "Thai", "Deva", "Beng", "Guru", "Mlym", "Taml"}
#: Spark's own lists for packs without one here.
_SPARK_LISTS = {"de": "german", "es": "spanish", "fi": "finnish", "fr": "french", "ru": "russian"}

_PACKS: dict[str, Language] = {}


def register(language: Language) -> None:
    """Adds a pack, or puts another in the place of one with its code."""
    _PACKS[language.code.lower()] = language


def _register_all() -> None:
    for entry in _NAMES.replace("\n", "|").split("|"):
        code, name, script = entry.split(" ")
        listed = tuple(w.replace("_", " ") for w in WORDS[code].split()) if code in WORDS else None
        register(Language(code, name.replace("_", " "), script, stemmers.STEMMERS.get(code), words if script in _BY_BOUNDARY else alphanumeric_tokens, listed))


_register_all()


def language_exact(code: str) -> Language | None:
    return _PACKS.get(code.lower())


def language(tag: str) -> Language | None:
    """By the longest known front of a tag."""
    parts = tag.replace("_", "-").split("-")
    return next((p for n in range(len(parts), 0, -1) if (p := language_exact("-".join(parts[:n])))), None)


def languages(spark: SparkSession) -> DataFrame:
    """(code, name, script, n_stop_words, has_stemmer): n_stop_words is null where a list must be given."""
    return spark.createDataFrame([(p.code, p.name, p.script, len(p.stop_words) if p.stop_words is not None else None, p.stem is not None) for p in _PACKS.values()], "code string, name string, script string, n_stop_words int, has_stemmer boolean")


def known(code: str) -> Language:
    pack = language(code)
    if pack is None:
        raise ValueError(f"no language pack for {code}")
    return pack


def stop_words(code: str) -> tuple[str, ...]:
    """The pack's list, or Spark's own; ValueError where there is neither."""
    pack = known(code)
    if pack.stop_words is not None:
        return pack.stop_words
    if pack.code in _SPARK_LISTS:
        return tuple(StopWordsRemover.loadDefaultStopWords(_SPARK_LISTS[pack.code]))
    raise ValueError(f"give a list of stop words for {pack.code}: with_stop_words(code, words)")


def with_stop_words(code: str, listed: list[str]) -> Language:
    """Registers the pack with another list and returns it."""
    pack = replace(known(code), stop_words=tuple(listed))
    register(pack)
    return pack


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_stop_word(c: Column, code: str) -> Column:
    return _ascii_lower(c).isin(*stop_words(code))


def remove_stop_words(tokens: Column, code: str) -> Column:
    listed = F.array(*map(F.lit, stop_words(code)))
    return F.filter(tokens, lambda t: ~F.array_contains(listed, _ascii_lower(t)))


def tokenize(c: Column, code: str) -> Column:
    return known(code).tokenize(c)


def stem(c: Column, code: str) -> Column:
    """Stems of a word column; languages without a stemmer give the words back."""
    f = known(code).stem
    return text_udf(f, "string")(c) if f else c


def stem_all(tokens: Column, code: str) -> Column:
    """Stems of an array of words."""
    f = known(code).stem
    return text_udf(lambda ws: [None if w is None else f(w) for w in ws], "array<string>")(tokens) if f else tokens


def stem_by_language(c: Column, code: Column) -> Column:
    """One stemmer per row, chosen by a column; unknown codes give the word back."""
    from loomtext.functions.batches import pair_udf

    def one(word: str, tag: str) -> str:
        pack = language(tag)
        return pack.stem(word) if pack and pack.stem else word

    return F.coalesce(pair_udf(one, "string")(c, code), c)


_CONTRACTIONS = r"(?i)(can)(not)\b|(\p{L}+)(n['’]t)\b|(\p{L}+)(['’](?:ll|ve|re|s|m|d))\b|(\p{L}[\p{L}\p{N}]*|\p{N}+)"


def english_tokens(c: Column) -> Column:
    """Words with their contractions split off: don't is do and n't, we'll is we and 'll."""
    import regex

    pattern = regex.compile(_CONTRACTIONS)
    return text_udf(lambda x: [g for m in pattern.finditer(x) for g in m.groups() if g], "array<string>")(c)
