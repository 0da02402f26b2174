"""Streaming content-defined chunking: bytes arrive in pieces, cuts are those of the whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtext.operators.chunking import Cdc, cut_points


def chunk_stream(pieces: DataFrame, cdc: Cdc, output_mode: str = "append") -> DataFrame:
    """(key, end, size) of the chunks of each key's text.

    ``pieces`` is a stream (key string, seq long, piece string, last boolean); pieces of a key come in the order of seq, within a
    batch in any. State is the text since the last cut, shorter than the largest chunk and a piece. The piece marked
    ``last`` ends the last chunk and the key's state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, base = state.get if state.exists else (b"", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        data = bytes(held) + "".join(x or "" for x in rows["piece"]).encode()
        over = bool(rows["last"].fillna(False).any())
        ends = cut_points(data, cdc)
        # the end of what has come so far may not be the chunk's end
        if ends and not over and ends[-1] == len(data):
            ends.pop()
        out = [(key[0], base + e, e - s) for s, e in zip([0, *ends], ends, strict=False)]
        cut = ends[-1] if ends else 0
        if over:
            state.remove()
        else:
            state.update((data[cut:], base + cut))
        yield pd.DataFrame(out, columns=["key", "end", "size"])

    return pieces.groupBy("key").applyInPandasWithState(step, "key string, end long, size long", "held binary, base long", output_mode, GroupStateTimeout.NoTimeout)
