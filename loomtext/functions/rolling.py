"""Rolling hashes of byte windows: polynomial, Buzhash, Rabin and gear, as arrays of all windows' values.

Values are unsigned 64-bit numbers, kept as signed longs of the same bits. Text is taken as UTF-8. Each hash is computed for
all windows of a text at once, from the closed form of what rolling byte by byte gives.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column

from loomtext.functions.batches import text_udf

_M64 = (1 << 64) - 1
# The polynomial's base and modulus, Rabin's polynomial, and the two tables' seeds.
POLYNOMIAL_BASE, POLYNOMIAL_MODULUS = 257, (1 << 61) - 1
RABIN_LOW = 0x1B  # x^64 + x^4 + x^3 + x + 1
GEAR_SEED, BUZ_SEED = 0x00C0FFEEC0FFEE00, 0x00BBBBBBBBBBBB00


def seeded_table(seed: int) -> list[int]:
    """256 outputs of a SplitMix64 generator. Fixed value: its second multiplier is the tables' own, not the published one."""
    out = []
    for i in range(1, 257):
        z = (seed + i * 0x9E3779B97F4A7C15) & _M64
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ z >> 27) * 0x94D49BB133111EB1) & _M64
        out.append(z ^ z >> 31)
    return out


GEAR = np.array(seeded_table(GEAR_SEED), np.uint64)
BUZ = np.array(seeded_table(BUZ_SEED), np.uint64)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return x if n == 0 else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def gear_hashes(data: bytes) -> np.ndarray:
    """After each byte: the last 64 bytes count, older ones are shifted out."""
    t = GEAR[np.frombuffer(data, np.uint8)]
    out = t.copy()
    with np.errstate(over="ignore"):
        # doubling: the sum over 2k bytes is that over k, and that over the k before shifted by k
        for k in (1, 2, 4, 8, 16, 32):
            out[k:] = out[k:] + (out[:-k] << np.uint64(k)) if len(out) > k else out[k:]
    return out


def buz_hashes(data: bytes, window: int) -> np.ndarray:
    """One value for each full window."""
    t = BUZ[np.frombuffer(data, np.uint8)]
    n = len(t) - window + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(window if n > 0 else 0):
        out ^= _rotated(t[k : k + n], window - 1 - k)
    return out


def polynomial_hashes(data: bytes, window: int) -> list[int]:
    """One value for each full window, modulo 2^61 - 1."""
    out, h, top = [], 0, pow(POLYNOMIAL_BASE, window, POLYNOMIAL_MODULUS)
    for i, b in enumerate(data):
        h = (h * POLYNOMIAL_BASE + b - (data[i - window] * top if i >= window else 0)) % POLYNOMIAL_MODULUS
        if i >= window - 1:
            out.append(h)
    return out


@lru_cache(maxsize=8)
def _rabin_tables(window: int) -> tuple[list[int], list[int]]:
    def times_x(v: int, n: int) -> int:
        for _ in range(n):
            v = ((v << 1) & _M64) ^ (RABIN_LOW if v >> 63 else 0)
        return v

    high = []  # of byte * x^64
    for b in range(256):
        v = 0
        for bit in range(8):
            if b >> bit & 1:
                v ^= times_x(RABIN_LOW, bit)
        high.append(v)
    units = [times_x(1 << bit, 8 * window) for bit in range(8)]
    leaving = []
    for b in range(256):
        v = 0
        for bit in range(8):
            if b >> bit & 1:
                v ^= units[bit]
        leaving.append(v)
    return high, leaving


def rabin_hashes(data: bytes, window: int) -> list[int]:
    """One value for each full window: its bytes as a polynomial over GF(2), reduced."""
    high, leaving = _rabin_tables(window)
    out, h = [], 0
    for i, b in enumerate(data):
        h = ((h << 8) & _M64) ^ high[h >> 56] ^ b
        if i >= window:
            h ^= leaving[data[i - window]]
        if i >= window - 1:
            out.append(h)
    return out


def _signed(values) -> list[int]:
    return np.array(values, np.uint64).view(np.int64).tolist()


KINDS = {"polynomial": polynomial_hashes, "buzhash": buz_hashes, "rabin": rabin_hashes, "gear": lambda data, window: gear_hashes(data)[max(0, window - 1) :]}


def rolling_hashes(c: Column, window: int, kind: str = "polynomial") -> Column:
    """array<long>: a value for each window of ``window`` bytes; shorter texts have none."""
    if window < 1:
        raise ValueError("window must be at least 1")
    of = KINDS[kind]
    return text_udf(lambda x: _signed(of(x.encode(), window)), "array<long>")(c)
