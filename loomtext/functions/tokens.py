"""Word pieces, and truncation and padding of token arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def wordpiece_word(word: str, vocabulary: dict[str, int], unknown: int, prefix: str = "##", longest: int = 100) -> list[int]:
    """Greedy longest pieces from the left; an over-long word, or one with a stretch without a piece, is unknown as a whole."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = vocabulary.get((prefix if at else "") + word[at:end])
            if piece is not None:
                out.append(piece)
                at = end
                break
        else:
            return [unknown]
    return out


def wordpiece(words: Column, vocabulary: dict[str, int], unknown: str = "[UNK]", prefix: str = "##", longest: int = 100) -> Column:
    """Token ids of an array of words; null arrays give null, null and empty words give nothing."""
    of_unknown = vocabulary[unknown]

    def apply(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [t for w in r if w for t in wordpiece_word(w, vocabulary, of_unknown, prefix, longest)] for r in rows], dtype=object)

    return F.pandas_udf(apply, "array<int>")(words)


def truncate(tokens: Column, most: int, side: str = "right") -> Column:
    """At most ``most`` tokens, cut from the given side."""
    if side == "right":
        return F.slice(tokens, F.lit(1), F.lit(most))
    return F.slice(tokens, F.greatest(F.size(tokens) - most, F.lit(0)) + 1, F.lit(most))


def truncate_pair(a: Column, b: Column, most: int) -> Column:
    """struct<a, b> with ``most`` tokens together: one at a time goes from the longer side, from ``a`` when equal."""
    over = F.greatest(F.size(a) + F.size(b) - most, F.lit(0))
    # the longer side first comes down to the other's size, then both give in turn, a first
    gap = F.abs(F.size(a) - F.size(b))
    first = F.least(over, gap)
    rest = over - first
    cut_a = F.when(F.size(a) > F.size(b), first).otherwise(0) + F.ceil(rest / 2).cast("int")
    cut_b = F.when(F.size(b) > F.size(a), first).otherwise(0) + F.floor(rest / 2).cast("int")
    return F.struct(F.slice(a, F.lit(1), F.greatest(F.size(a) - cut_a, F.lit(0))).alias("a"), F.slice(b, F.lit(1), F.greatest(F.size(b) - cut_b, F.lit(0))).alias("b"))


def pad(tokens: Column, to: Column | int, token: int, side: str = "right") -> Column:
    """Tokens filled up to ``to``; longer arrays stay."""
    size = F.lit(to) if isinstance(to, int) else to
    fill = F.array_repeat(F.lit(token), F.greatest(size - F.size(tokens), F.lit(0)))
    return F.concat(tokens, fill) if side == "right" else F.concat(fill, tokens)
