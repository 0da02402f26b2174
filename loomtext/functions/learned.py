"""Learned edit distance: costs of deletions, insertions and substitutions, fitted to pairs by expectation maximisation.

A model gives every edit event and the end a probability; they sum to one. The distance of two texts is the cost
(-log probability) of their best edit sequence and the end. Letters that the model doesn't know make it infinite.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.batches import pair_udf

END = ("", "")


@dataclass(frozen=True)
class LearnedModel:
    """Probabilities by event: (x, "") deletes, ("", y) inserts, (x, y) substitutes or keeps, ("", "") ends."""

    probabilities: dict[tuple[str, str], float]

    @classmethod
    def uniform(cls, alphabet: str) -> LearnedModel:
        letters = sorted(set(alphabet))
        events = [(x, y) for x in ["", *letters] for y in ["", *letters]]
        return cls(dict.fromkeys(events, 1 / len(events)))

    def mass(self) -> float:
        """One, but for rounding."""
        return math.fsum(self.probabilities.values())

    def cost(self, event: tuple[str, str]) -> float:
        p = self.probabilities.get(event, 0.0)
        return -math.log(p) if p > 0 else math.inf

    def distance(self, source: str, target: str) -> float:
        row = [0.0]
        for y in target:
            row.append(row[-1] + self.cost(("", y)))
        for x in source:
            drop, last = self.cost((x, "")), row
            row = [last[0] + drop]
            for j, y in enumerate(target, 1):
                row.append(min(last[j] + drop, row[-1] + self.cost(("", y)), last[j - 1] + self.cost((x, y))))
        return row[-1] + self.cost(END)


def expected_counts(model: LearnedModel, source: str, target: str) -> dict[tuple[str, str], float]:
    """How often each event is expected in the edit sequences of a pair; none where the pair has no probability."""
    p, n, m = model.probabilities, len(source), len(target)
    ahead = [[0.0] * (m + 1) for _ in range(n + 1)]
    back = [[0.0] * (m + 1) for _ in range(n + 1)]
    ahead[0][0] = 1.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                ahead[i][j] += ahead[i - 1][j] * p.get((source[i - 1], ""), 0.0)
            if j:
                ahead[i][j] += ahead[i][j - 1] * p.get(("", target[j - 1]), 0.0)
            if i and j:
                ahead[i][j] += ahead[i - 1][j - 1] * p.get((source[i - 1], target[j - 1]), 0.0)
    back[n][m] = p.get(END, 0.0)
    total = ahead[n][m] * back[n][m]
    out: dict[tuple[str, str], float] = defaultdict(float)
    if total <= 0:
        return out
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            steps = []
            if i < n:
                steps.append(((source[i], ""), i + 1, j))
            if j < m:
                steps.append((("", target[j]), i, j + 1))
            if i < n and j < m:
                steps.append(((source[i], target[j]), i + 1, j + 1))
            for event, a, b in steps:
                chance = p.get(event, 0.0) * back[a][b]
                back[i][j] += chance
                if chance:
                    out[event] += ahead[i][j] * chance / total
    out[END] += 1.0
    return out


def train(pairs: DataFrame, *, source_col: str, target_col: str, alphabet: str, rounds: int = 5, smoothing: float = 1e-6) -> LearnedModel:
    """Expectation steps run over the pairs' partitions, whose counts are summed by event with map-side combining; the driver sees one
    row an event. Pairs with a null, or with letters outside the alphabet, are left out."""
    model = LearnedModel.uniform(alphabet)
    events = sorted(model.probabilities)
    rows = pairs.select(F.col(source_col).alias("source"), F.col(target_col).alias("target")).where("source is not null and target is not null")
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[str, str], float] = defaultdict(float)
            for batch in batches:
                for x, y in zip(batch["source"], batch["target"], strict=True):
                    for event, n in expected_counts(model, x, y).items():
                        sums[event] += n
            yield pd.DataFrame([(a, b, n) for (a, b), n in sums.items()], columns=["a", "b", "n"])

        counts = {(r.a, r.b): r.n for r in rows.mapInPandas(expect, "a string, b string, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
        total = math.fsum(counts.get(e, 0.0) + smoothing for e in events)
        model = LearnedModel({e: (counts.get(e, 0.0) + smoothing) / total for e in events})
    return model


def learned_distance(a: Column, b: Column, model: LearnedModel) -> Column:
    return pair_udf(model.distance, "double")(a, b)
