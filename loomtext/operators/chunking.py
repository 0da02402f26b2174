"""Content-defined byte chunking and retrieval-oriented text splitting, as exploded rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.batches import text_udf
from loomtext.functions.rolling import gear_hashes
from loomtext.functions.segments import sentence_list

# Least, average and most bytes of a chunk, and the masks up to the average and after it.
PRESETS = {"8k": (2048, 8192, 65536, 0x0003590703530000, 0x0000D90003530000), "16k": (4096, 16384, 131072, 0x0007590703530000, 0x0001D90003530000)}


@dataclass(frozen=True)
class Cdc:
    """Chunk sizes and masks: no cut below ``least`` bytes, ``strict`` up to ``average``, ``loose`` after, a cut at ``most``."""

    least: int
    average: int
    most: int
    strict: int
    loose: int

    @classmethod
    def preset(cls, name: str) -> Cdc:
        return cls(*PRESETS[name])

    @classmethod
    def around(cls, least: int, average: int, most: int) -> Cdc:
        """Masks with one bit more and one less than the average's."""
        bits = average.bit_length() - 1
        return cls(least, average, most, ((1 << bits + 1) - 1) << 16, ((1 << bits - 1) - 1) << 16)


def cut_points(data: bytes, cdc: Cdc) -> list[int]:
    """Chunk ends. A chunk's hash begins at its byte number ``least``, so at each place it is the gear hash of the bytes since then, 64 at most."""
    ends, start, n = [], 0, len(data)
    block = 1 << 14
    while start < n:
        stop, first, cut = min(n, start + cdc.most), start + cdc.least - 1, 0
        at = first
        while at < stop and not cut:
            # each block with the 63 bytes before it, as far as these are hashed at all
            warm = max(first, at - 63)
            h = gear_hashes(data[warm : min(stop, at + block)])[at - warm :]
            sizes = np.arange(at - start + 1, at - start + 1 + len(h))
            masked = np.where(sizes <= cdc.average, h & np.uint64(cdc.strict), h & np.uint64(cdc.loose))
            hit = np.flatnonzero((masked == 0) | (sizes >= cdc.most))
            if len(hit):
                cut = at + int(hit[0]) + 1
            at += block
        start = cut or stop
        ends.append(start)
    return ends


def fastcdc(df: DataFrame, *, id_col: str, text_col: str, cdc: Cdc = Cdc(*PRESETS["8k"])) -> DataFrame:
    """(id, chunk, end, size): byte offsets in the UTF-8 text; null and empty texts have no chunks."""
    cut = df.select(F.col(id_col).alias("id"), text_udf(lambda x: cut_points(x.encode(), cdc), "array<int>")(F.col(text_col)).alias("ends"))
    rows = cut.select("id", "ends", F.posexplode("ends").alias("chunk", "end"))
    return rows.select("id", "chunk", "end", (F.col("end") - F.when(F.col("chunk") > 0, F.get("ends", F.col("chunk") - 1)).otherwise(0)).alias("size"))


def split_recursive(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` code points; the coarsest separator that helps is used, small neighbours are joined by a space."""
    if len(text) <= size:
        return [text] if text else []
    for k, sep in enumerate(separators):
        if sep and sep not in text:
            continue
        parts = text.split(sep) if sep else [text[i : i + size] for i in range(0, len(text), size)]
        out: list[str] = []
        for part in parts:
            for piece in split_recursive(part, size, separators[k + 1 :]) if len(part) > size else [part] * bool(part):
                if out and len(out[-1]) + 1 + len(piece) <= size:
                    out[-1] += " " + piece
                else:
                    out.append(piece)
        return out
    return [text]


def split_paragraphs(text: str, size: int) -> list[str]:
    return [p for para in text.split("\n\n") if para for p in split_recursive(para, size)]


def split_sentences(text: str, size: int) -> list[str]:
    """Sentences packed greedily; a longer one stays whole."""
    out: list[str] = []
    for s in map(str.strip, sentence_list(text)):
        if s and out and len(out[-1]) + 1 + len(s) <= size:
            out[-1] += " " + s
        elif s:
            out.append(s)
    return out


def overlapped(pieces: list[str], overlap: int) -> list[str]:
    """Each piece behind the end of the one before, so pieces can pass the size by ``overlap``."""
    return [(pieces[i - 1][-overlap:] if i and overlap else "") + x for i, x in enumerate(pieces)]


def split_texts(df: DataFrame, splitter: Callable[[str, int], list[str]], *, size: int, overlap: int = 0, id_col: str, text_col: str) -> DataFrame:
    """(id, chunk, text) rows of any splitter; null and empty texts have none."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, t) for i, x in zip(pdf["id"], pdf["text"], strict=True) for k, t in enumerate(overlapped(splitter(x or "", size), overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "text"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(step, f"id {source.schema['id'].dataType.simpleString()}, chunk int, text string")
