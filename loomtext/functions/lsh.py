"""Locality-sensitive hashes of weighted sets and dense vectors.

Every random number comes from SplitMix64 of the seed and its place, so keys agree between runs and machines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.sketches import fnv1a, splitmix


def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from the top 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def projection(dim: int, width: float, family: str = "gaussian", seed: int = 0) -> tuple[list[float], float]:
    """Coefficients of one hash function and its shift in [0, width)."""
    if family not in ("gaussian", "cauchy") or width <= 0 or dim < 1:
        raise ValueError("family is gaussian or cauchy, width and dim are positive")
    u = _uniform(splitmix(splitmix(np.array([seed], np.uint64)) ^ np.arange(2 * dim + 1, dtype=np.uint64)))
    a, b = u[:dim], u[dim : 2 * dim]
    drawn = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b) if family == "gaussian" else np.tan(np.pi * (a - 0.5))
    return drawn.tolist(), float(u[-1] * width)


def p_stable_bucket(vector: Column, dim: int, width: float, family: str = "gaussian", seed: int = 0) -> Column:
    """floor((a.v + b) / width). Vectors that are null or of another size, or hold nulls or NaN, give null."""
    drawn, shift = projection(dim, width, family, seed)
    dot = F.aggregate(F.zip_with(vector, F.array(*map(F.lit, drawn)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(vector) == dim) & ~F.isnan(dot), F.floor((dot + shift) / width))


def weighted_minhash_values(weights: dict[str, float], k: int, seed: int = 0) -> list[tuple[int, int]]:
    """Consistent weighted sampling: k pairs (gram hash, step); weights of zero or less are left out."""
    items = [(g, w) for g, w in weights.items() if g is not None and w is not None and w > 0]
    if any(math.isnan(w) for _, w in weights.items() if w is not None):
        raise ValueError("a weight is NaN")
    if not items:
        return []
    base, log_w = fnv1a([g.encode() for g, _ in items]), np.log([w for _, w in items])
    out = []
    for slot in splitmix(np.uint64(seed) ^ np.arange(k, dtype=np.uint64)):
        own = splitmix(base ^ slot)
        u1, u2, u3, u4, beta = (_uniform(splitmix(own ^ np.uint64(j))) for j in range(1, 6))
        r, c = -np.log(u1 * u2), -np.log(u3 * u4)
        step = np.floor(log_w / r + beta)
        best = int(np.argmin(np.log(c) - r * (step - beta) - r))
        out.append((int(base[best : best + 1].view(np.int64)[0]), int(step[best])))
    return out


def weighted_minhash(weights: Column, k: int = 64, seed: int = 0) -> Column:
    """array<struct<key, step>> of a map from gram to weight; null maps give null, empty ones an empty array."""

    def apply(maps: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else [{"key": a, "step": b} for a, b in weighted_minhash_values(dict(m), k, seed)] for m in maps], dtype=object)

    return F.pandas_udf(apply, "array<struct<key:long,step:long>>")(weights)


def weighted_jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty sketches give 1, one empty gives 0."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(a) != F.size(b), 0.0).otherwise(same / F.size(a))
