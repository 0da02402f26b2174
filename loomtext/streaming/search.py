"""Streaming multi-pattern search: texts arrive in pieces, matches may span them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.functions.patterns import MultiPattern


def search_stream(pieces: DataFrame, patterns: list[str], output_mode: str = "append") -> DataFrame:
    """(key, position, pattern_index) of overlapping matches in each key's text.

    ``pieces`` is a stream (key string, seq long, piece string). State is the end of the text seen, one code point shorter
    than the longest pattern, and its length, so it doesn't grow. All patterns are found in one pass. Pieces are taken in the order of
    seq within a batch; one that comes in a later batch follows all before it. Null pieces are empty.
    """
    automaton = MultiPattern([p for p in patterns if p])
    number = [k for k, p in enumerate(patterns) if p]
    reach = max(map(len, automaton.patterns), default=1) - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, seen = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for piece in rows["piece"]:
            text, base = tail + (piece or ""), seen - len(tail)
            # what lies in the old end alone was reported before
            out += [(key[0], base + at, number[k]) for at, k in automaton.places(text) if at + len(automaton.patterns[k]) > len(tail)]
            seen += len(piece or "")
            tail = text[-reach:] if reach else ""
        state.update((tail, seen))
        yield pd.DataFrame(sorted(out), columns=["key", "position", "pattern_index"])

    return pieces.groupBy("key").applyInPandasWithState(step, "key string, position long, pattern_index int", "tail string, seen long", output_mode, GroupStateTimeout.NoTimeout)
