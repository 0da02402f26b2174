"""Extension points: metrics, sketches, splitters, diffs and languages that users add by name, and checks of them.

A metric is a Column function of two columns with what is known of it; index-like operators refuse metrics that lack the
properties they rely on. Exhaustive inputs and ``differential_check`` hold one function against another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import collation, grams, kernels, rolling, transliteration
from loomtext.functions.alignment import AFFINE, BLAST, LINEAR, Scoring
from loomtext.operators import chunking, diff


@dataclass(frozen=True)
class Metric:
    """``kind`` is distance or similarity. A distance is a metric if it is symmetric, zero for equals only, and never shorter by a detour."""

    name: str
    of: Callable[[Column, Column], Column]
    kind: str = "distance"
    symmetric: bool = True
    identity: bool = True
    triangle: bool = False

    @property
    def is_metric(self) -> bool:
        return self.kind == "distance" and self.symmetric and self.identity and self.triangle


METRICS: dict[str, Metric] = {}


def register_metric(metric: Metric) -> None:
    METRICS[metric.name] = metric


for _m in (
    Metric("levenshtein", F.levenshtein, triangle=True),
    Metric("damerau", kernels.damerau, triangle=True),
    Metric("osa", kernels.osa),
    Metric("hamming", grams.hamming, triangle=True),
    Metric("lcs", kernels.lcs_distance, triangle=True),
    Metric("jaro", kernels.jaro_sim, "similarity"),
    Metric("jaro_winkler", kernels.jaro_winkler_sim, "similarity"),
):
    register_metric(_m)


def require_metric(name: str) -> Metric:
    """For what prunes by the triangle inequality; raises ValueError for others."""
    metric = METRICS[name]
    if not metric.is_metric:
        raise ValueError(f"{name} is not a metric")
    return metric


class RollingHash(Protocol):
    """All windows' values of some bytes."""

    def __call__(self, data: bytes, window: int) -> list[int]: ...


class TextSplitter(Protocol):
    """Pieces of a text of about a size."""

    def __call__(self, text: str, size: int) -> list[str]: ...


class DiffAlgorithm(Protocol):
    """A script of keep, delete and insert."""

    def __call__(self, a: list[str], b: list[str]) -> list[tuple[str, str]]: ...


class ColumnFunction(Protocol):
    """What transliterators, sort keys, n-gram generators and stemmers are: a Column of a Column."""

    def __call__(self, c: Column) -> Column: ...


ROLLING_HASHES: dict[str, RollingHash] = rolling.KINDS
SPLITTERS: dict[str, TextSplitter] = {"recursive": chunking.split_recursive, "paragraphs": chunking.split_paragraphs, "sentences": chunking.split_sentences}
DIFFS: dict[str, DiffAlgorithm] = diff.ALGORITHMS
SCORINGS: dict[str, Scoring] = {"linear": LINEAR, "blast": BLAST, "affine": AFFINE}
TRANSLITERATORS: dict[str, ColumnFunction] = {"iso9": transliteration.ISO9, "ascii": transliteration.to_ascii, "serbian": transliteration.SERBIAN_LATIN}
SORT_KEYS: dict[str, ColumnFunction] = {"ascii_ci": collation.ascii_ci_key, "natural": collation.natural_key, "din5007": collation.din5007_key, "library": collation.library_key}


def exhaustive(alphabet: str, longest: int) -> Iterator[str]:
    """Every text over an alphabet up to a length, shorter ones first, then in the alphabet's order."""
    for n in range(longest + 1):
        for letters in product(alphabet, repeat=n):
            yield "".join(letters)


def exhaustive_texts(spark: SparkSession, alphabet: str, longest: int) -> DataFrame:
    """(text) of ``exhaustive``, made on the executors from numbers."""
    k = len(alphabet)
    out = None
    for n in range(longest + 1):
        letter = lambda i, n=n: F.substring(F.lit(alphabet), (F.floor(F.col("id") / F.lit(k ** (n - 1 - i))) % k).cast("int") + 1, F.lit(1))
        part = spark.range(k**n).select(F.concat(F.lit(""), *[letter(i) for i in range(n)]).alias("text"))
        out = part if out is None else out.unionAll(part)
    return out


def exhaustive_pairs(spark: SparkSession, alphabet: str, longest: int) -> DataFrame:
    """(left, right): ordered pairs, a stated small set against itself."""
    texts = exhaustive_texts(spark, alphabet, longest)
    return texts.withColumnRenamed("text", "left").join(F.broadcast(texts.withColumnRenamed("text", "right")), F.lit(True))


def differential_check(inputs: DataFrame, oracle: Column, candidate: Column) -> DataFrame:
    """The rows of ``inputs`` for which the two columns differ, with both (nulls are equal)."""
    rows = inputs.select("*", oracle.alias("oracle_output"), candidate.alias("candidate_output"))
    return rows.where(~F.col("oracle_output").eqNullSafe(F.col("candidate_output")))
