"""A join by key that no crowded key holds up.

Scale: of the keys, at most ``MOST_HOT`` have more rows than a share of all rows (or than ``HOT_ROWS``, in small tables). These
come from a broadcast table, which that number bounds, so their rows stay where they lie; the rows of all others meet their key
by an exchange, in which none has more than that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 64
MOST_HOT = 100_000


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inner join of ``rows`` with ``keyed``, which has each key once and in ``count`` (not returned) about how many rows it has.

    Both are read twice, so they should be written tables. Null keys match nothing.
    """
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) > max(hot_rows, int(total) // MOST_HOT)
    values = [c for c in keyed.columns if c not in keys and c != count]
    crowd = keyed.where(hot).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    same = F.lit(True)
    for k in keys:
        same = same & (rows[k] == F.col(f"_hot_{k}"))
    marked = rows.join(F.broadcast(crowd), same, "left")
    names = rows.columns
    of_crowd = marked.where("_hot").select(*names, *[F.col(f"_hot_{v}").alias(v) for v in values])
    others = marked.where("_hot is null").select(*names).join(keyed.where(~hot).drop(count), keys)
    return of_crowd.unionAll(others.select(*names, *values))
