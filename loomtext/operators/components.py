"""Connected components of an edge table by alternating large-star and small-star steps.

Scale: each step is one map-side combined minimum per node and one join; no neighbour list is ever
gathered, so a hub is only a skewed join key, which adaptive execution splits. Every step is
written to the shared folder, which bounds the lineage, and deleted after the next; the driver sees one count and one checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; the root is the component's least node.

    Self-loops and nulls are ignored, repeated edges don't matter, no edges give no rows.
    """
    clean = lambda e: e.where("u <> v").distinct()
    now = materialise(clean(edges), "edges")
    seen = None
    for _ in range(max_steps):
        before, now = now, materialise(clean(_small_star(clean(_large_star(now)))), "edges")
        discard(before)
        # two runs of a step over the same stars give the same stars
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
