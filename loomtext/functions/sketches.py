"""Portable sketches of gram arrays: MinHash, one-permutation MinHash and SimHash with 64-bit wrap-around hashes.

A gram's base hash is FNV-1a over its UTF-8 bytes; slots mix it with SplitMix64. Values are unsigned and
kept as signed longs of the same bits. Arrow UDFs, since SQL arithmetic raises where these wrap. Null arrays give
null, null grams are left out; arrays without grams give the empty sketch (all bits set, or zero for SimHash).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published FNV-1a and SplitMix64 constants.
_FNV_BASIS, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
_STEP, _MUL1, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + _STEP
        z = (z ^ (z >> np.uint64(30))) * _MUL1
        z = (z ^ (z >> np.uint64(27))) * _MUL2
    return z ^ (z >> np.uint64(31))


def fnv1a(grams: list[bytes]) -> np.ndarray:
    """Hashes of all grams, one byte position at a time."""
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    flat = np.frombuffer(b"".join(grams), np.uint8)
    order = np.argsort(-sizes, kind="stable")  # those still running are a prefix
    starts, hashes = (np.cumsum(sizes) - sizes)[order], np.full(len(grams), _FNV_BASIS)
    running = len(grams) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
    with np.errstate(over="ignore"):
        for p, n in enumerate(running.tolist()):
            hashes[:n] = (hashes[:n] ^ flat[starts[:n] + p]) * _FNV_PRIME
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


def _bases(grams) -> np.ndarray:
    return fnv1a([g.encode() for g in grams if g is not None])


def _slots(seed: int, k: int) -> np.ndarray:
    return splitmix(np.uint64(seed) ^ np.arange(k, dtype=np.uint64))


def minhash_values(grams, k: int, seed: int = 0) -> np.ndarray:
    base, out = _bases(grams), np.full(k, EMPTY)
    for i, slot in enumerate(_slots(seed, k)):
        out[i] = splitmix(base ^ slot).min(initial=EMPTY)
    return out


def one_permutation_values(grams, k: int, seed: int = 0) -> np.ndarray:
    """One hash a gram, the least in each of k bins; an empty bin borrows from the next full one to its right."""
    mixed, out = splitmix(_bases(grams) ^ _slots(seed, 1)[0]), np.full(k, EMPTY)
    # the high word of mixed * k, in halves so that nothing wraps
    high, low = mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF)
    bins = ((high * np.uint64(k) + ((low * np.uint64(k)) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, bins, mixed)
    full = np.zeros(k, bool)
    full[bins] = True
    if not full.any() or full.all():
        return out
    at = np.flatnonzero(full)
    empty = np.flatnonzero(~full)
    source = at[np.searchsorted(at, empty) % len(at)]
    hops = ((source - empty) % k).astype(np.uint64)
    out[empty] = splitmix(out[source] ^ splitmix(hops))
    return out


def simhash_value(grams, seed: int = 0) -> int:
    """Bit i votes by the top bit of slot i's hash, repeats counted; a tie sets the bit."""
    base = _bases(grams)
    if not len(base):
        return 0
    votes = [2 * int((splitmix(base ^ slot) >> np.uint64(63)).sum()) >= len(base) for slot in _slots(seed, 64)]
    return sum(1 << i for i, on in enumerate(votes) if on)


def _udf(kind: str, of):
    def apply(grams: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else of(g) for g in grams], dtype=object)

    return F.pandas_udf(apply, kind)


def minhash(grams: Column, k: int = 64, seed: int = 0) -> Column:
    return _udf("array<long>", lambda g: minhash_values(g, k, seed).view(np.int64))(grams)


def one_permutation(grams: Column, k: int = 64, seed: int = 0) -> Column:
    return _udf("array<long>", lambda g: one_permutation_values(g, k, seed).view(np.int64))(grams)


def one_permutation_rows(df: DataFrame, *, id_col: str, gram_col: str, k: int = 64, seed: int = 0) -> DataFrame:
    """(id, o) with o as ``one_permutation``, for grams of any expression.

    Where a Python call's argument nests lambdas (``grams.token_ngrams`` over a filter), Spark 4.1 can fail to take the call out of the
    projection and then can't evaluate it; here the grams are a column of the rows that Python reads.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if g is None else one_permutation_values(g, k, seed).view(np.int64) for g in batch["grams"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, pa.list_(pa.int64()))], names=["id", "o"])

    rows = df.select(F.col(id_col).alias("id"), F.col(gram_col).alias("grams"))
    return rows.mapInArrow(step, f"id {rows.schema['id'].dataType.simpleString()}, o array<bigint>").withColumnRenamed("id", id_col)


def simhash(grams: Column, seed: int = 0) -> Column:
    return _udf("long", lambda g: int(np.array([simhash_value(g, seed)], np.uint64).view(np.int64)[0]))(grams)


def simhash_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity estimated from the differing bits."""
    return F.cos(F.lit(np.pi) * F.bit_count(a.bitwiseXOR(b)) / 64)


def simhash_votes(features: dict[str, int], seed: int = 0) -> np.ndarray:
    """128 sums of weights, counted for where a feature's hash has the bit and against where it hasn't."""
    grams = [g for g in features if g is not None]
    if not grams:
        return np.zeros(128, np.int64)
    base = _bases(grams)
    halves = np.stack([splitmix(base ^ slot) for slot in _slots(seed, 2)], axis=1)
    bits = np.unpackbits(halves.view(np.uint8).reshape(len(grams), 16), axis=1, bitorder="little").astype(np.int64)
    return (np.array([features[g] for g in grams], np.int64)[:, None] * (2 * bits - 1)).sum(axis=0)


def _bits_of(votes: np.ndarray) -> list[int]:
    """Two longs; a tie is a zero bit."""
    return np.packbits(votes > 0, bitorder="little").view(np.int64).tolist()


def simhash_128(weights: Column, seed: int = 0) -> Column:
    """struct<lo, hi> of a map<string, long> of weighted features; the 64-bit form is ``lo``. No features give zeros."""

    def apply(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if r is None else _bits_of(simhash_votes(dict(r), seed)) for r in rows], columns=["lo", "hi"])

    return F.when(weights.isNotNull(), F.pandas_udf(apply, "struct<lo:long,hi:long>")(weights))


def simhash_64(weights: Column, seed: int = 0) -> Column:
    return simhash_128(weights, seed)["lo"]


def simhash_128_of(grams: Column, seed: int = 0) -> Column:
    """struct<lo, hi> of an array, each gram weighing as often as it occurs."""

    def apply(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if r is None else _bits_of(simhash_votes(dict(Counter(g for g in r if g is not None)), seed)) for r in rows], columns=["lo", "hi"])

    return F.when(grams.isNotNull(), F.pandas_udf(apply, "struct<lo:long,hi:long>")(grams))


def simhash_bands(value: Column, bands: int, width: int = 64) -> Column:
    """array<long>: equal slices of the bits, the lowest first; ``width`` bits must divide into them."""
    if width % bands:
        raise ValueError("the bands must divide the bits")
    size = width // bands
    mask = (1 << size) - 1
    return F.array(*[F.shiftrightunsigned(value, i * size).bitwiseAND(F.lit(mask if size < 64 else -1)) for i in range(bands)])


def simhash_bands_128(value: Column, bands: int) -> Column:
    """The bands of both halves of ``simhash_128``, half of them from each."""
    if bands % 2:
        raise ValueError("each half has the same number of bands")
    return F.concat(simhash_bands(value["lo"], bands // 2), simhash_bands(value["hi"], bands // 2))


def simhash_hamming_128(a: Column, b: Column) -> Column:
    return F.bit_count(a["lo"].bitwiseXOR(b["lo"])) + F.bit_count(a["hi"].bitwiseXOR(b["hi"]))
