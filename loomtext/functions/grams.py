"""n-grams, set and multiset similarities, sketches and text statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = "﻿"


def bound(c: Column, body) -> Column:
    """``body`` of the value of ``c``, which is computed once even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(c), body)[0]


def _windows(n: int, size: Column, at) -> Column:
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), at)).when(size < n, F.array().cast("array<string>"))


def char_ngrams(c: Column, n: int, padded: bool = False) -> Column:
    """Code-point windows; shorter text has none."""
    text = F.concat(F.lit(PAD * (n - 1)), c, F.lit(PAD * (n - 1))) if padded else c
    return _windows(n, F.length(text), lambda i: F.substring(text, i, F.lit(n)))


def token_ngrams(tokens: Column, n: int, joiner: str = " ") -> Column:
    return bound(tokens, lambda t: _windows(n, F.size(t), lambda i: F.array_join(F.slice(t, i, F.lit(n)), joiner)))


def grapheme_ngrams(c: Column, n: int) -> Column:
    return token_ngrams(F.regexp_extract_all(c, F.lit(r"(\X)"), F.lit(1)), n, "")


def padded(items: Column, prefix: list, suffix: list) -> Column:
    """An array between two stated ones; ``gram_count`` says how many grams follow."""
    kind = "array<string>"
    return F.concat(F.array(*map(F.lit, prefix)).cast(kind), items, F.array(*map(F.lit, suffix)).cast(kind))


def padding_length(n: int, boundary: bool = True) -> int:
    """On each side: n - 1 with boundary padding, else none."""
    return n - 1 if boundary else 0


def gram_count(size: Column, n: int, prefix: int = 0, suffix: int = 0) -> Column:
    """Grams of ``size`` units between paddings."""
    return F.greatest(size + prefix + suffix - n + 1, F.lit(0))


def token_grams(tokens: Column, n: int) -> Column:
    """array<array<string>>: windows that aren't joined."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return bound(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>")))


def token_ngrams_padded(tokens: Column, n: int, joiner: str = " ") -> Column:
    """With n - 1 empty tokens on each side."""
    return token_ngrams(padded(tokens, [""] * (n - 1), [""] * (n - 1)), n, joiner)


def grapheme_ngrams_padded(c: Column, n: int) -> Column:
    clusters = F.regexp_extract_all(c, F.lit(r"(\X)"), F.lit(1))
    return token_ngrams(padded(clusters, [PAD] * (n - 1), [PAD] * (n - 1)), n, "")


def byte_ngrams(c: Column, n: int, pad: bool = False) -> Column:
    """array<string> of hexadecimal digits of UTF-8 byte windows, with n - 1 zero bytes on each side if asked for."""
    edge = "00" * (n - 1) if pad else ""
    digits = F.concat(F.lit(edge), F.lower(F.hex(F.encode(c, "UTF-8"))), F.lit(edge))
    size = (F.length(digits) / 2).cast("int")
    return _windows(n, size, lambda i: F.substring(digits, 2 * i - 1, F.lit(2 * n)))


def jaccard_distance(a: Column, b: Column) -> Column:
    return 1 - jaccard(a, b)


def intersection_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct grams; two empty sets are 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    both_empty = F.size(F.array_union(a, b)) == 0
    return F.when(both_empty, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def hamming(a: Column, b: Column) -> Column:
    """Null for different lengths."""
    same = F.length(a) == F.length(b)
    return F.when(same & (F.length(a) == 0), 0).when(same, F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x)))


def minhash(grams: Column, k: int = 64) -> Column:
    """k least values of seeded 64-bit hashes; no grams give the largest values."""
    top = F.lit((1 << 63) - 1)
    return bound(grams, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.aggregate(all_, top, lambda acc, g: F.least(acc, F.xxhash64(s, g)))))


def minhash_similarity(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    return bound(signature, lambda sig: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(sig, i * rows + 1, F.lit(rows)))))


def collision_probability(similarity: Column, bands: int, rows: int) -> Column:
    return 1 - F.pow(1 - F.pow(similarity, F.lit(rows)), F.lit(bands))


def suggest_bands(target: float, size: int) -> tuple[int, int]:
    """(bands, rows) whose threshold (1/bands)^(1/rows) is nearest the target."""
    options = [(size // r, r) for r in range(1, size + 1) if size % r == 0]
    return min(options, key=lambda o: (abs((1 / o[0]) ** (1 / o[1]) - target), o[1]))


def simhash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def winnow(hashes: Column, window: int) -> Column:
    """(position, hash) of the rightmost least hash of each window, each position once."""
    n = F.size(hashes)

    def pick(i: Column) -> Column:
        pairs = F.transform(F.slice(hashes, i, F.lit(window)), lambda h, j: F.struct(h.alias("hash"), (-(i + j - 1)).alias("back")))
        return F.array_min(pairs)

    picks = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), pick))
    return F.array_distinct(F.transform(picks, lambda p: F.struct((-p["back"]).alias("position"), p["hash"].alias("hash"))))


def entropy(c: Column) -> Column:
    """Bits per code point; the empty text has 0."""
    chars = F.split(c, "")
    n = F.length(c)
    p = lambda ch: (n - F.length(F.replace(c, ch, F.lit("")))) / n
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc - p(ch) * F.log2(p(ch))))


def class_ratio(c: Column, character_class: str) -> Column:
    """Share of code points in a class such as ``\\p{P}``; the empty text has 0."""
    return F.when(F.length(c) == 0, 0.0).otherwise(F.regexp_count(c, F.lit(f"[{character_class}]")) / F.length(c))


#: Two-letter general categories.
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()


def category_histogram(c: Column) -> Column:
    """map<string, int> of the categories that occur."""
    counts = F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_count(c, F.lit(rf"\p{{{k}}}")).alias("value")) for k in CATEGORIES])
    return F.map_from_entries(F.filter(counts, lambda e: e["value"] > 0))


def major_histogram(c: Column) -> Column:
    """map<string, int> by the first letter: L, M, N, P, S, Z and C."""
    counts = F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_count(c, F.lit(rf"\p{{{k}}}")).alias("value")) for k in "LMNPSZC"])
    return F.map_from_entries(F.filter(counts, lambda e: e["value"] > 0))


#: Java character classes of the reported shares.
RATIO_CLASSES = {"control": r"\p{Cc}", "printable": r"\P{Cc}", "whitespace": r"\p{IsWhite_Space}", "digit": "0-9", "alphabetic": r"\p{IsAlphabetic}", "punctuation": r"\p{P}"}


def ratios(c: Column) -> Column:
    """struct of the share of code points in each of ``RATIO_CLASSES``; the empty text has zeros."""
    return F.struct(*[class_ratio(c, k).alias(name) for name, k in RATIO_CLASSES.items()])


def length_bounds(size: Column, threshold: Column) -> tuple[Column, Column]:
    """Sizes that can reach a Jaccard threshold with a set of ``size``."""
    return F.ceil(size * threshold - 1e-9), F.floor(size / threshold + 1e-9)
