"""Exact k nearest vectors of a stated query set, against all rows.

Scale: queries go out in blocks of ``block`` vectors (a bounded broadcast of block * dim numbers); each Arrow
batch of the table yields at most k rows a query, and a window by query ranks these. The table is read once
per block and never shuffled; at most k rows a query and batch are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.session import scratch_dir

BLOCK = 1024
DIGITS = 6


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def nearest(queries: DataFrame, items: DataFrame, *, id_col: str, vector_col: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, dist, rank): k least Euclidean distances, rounded to 6 digits, ties by id.

    A row is not its own neighbour. Rows with a null id, or a null or NaN in the vector, take no part;
    vectors of another size than a query's are no neighbours of it. Query rows that repeat an id are ranked as one query.
    """
    spark, found = items.sparkSession, None
    table = _usable(items, id_col, vector_col)
    asked = _usable(queries, id_col, vector_col).distinct()
    schema = "query_id long, item_id long, dist double"

    def step_for(ids: np.ndarray, vectors: list[np.ndarray]):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                item, rows = batch["id"].to_numpy(), batch["v"]
                sizes = np.diff(rows.offsets.to_numpy())
                for n in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == n)
                    own = np.array(rows.take(pa.array(at)).flatten()).reshape(len(at), n)
                    q_out, i_out, d_out = [], [], []
                    for q, v in zip(ids.tolist(), vectors, strict=True):
                        if len(v) != n:
                            continue
                        d = np.round(np.sqrt(((own - v) ** 2).sum(axis=1)), DIGITS)
                        other = np.flatnonzero(item[at] != q)
                        best = other[np.lexsort((item[at][other], d[other]))[:k]]
                        q_out += [q] * len(best)
                        i_out += item[at][best].tolist()
                        d_out += d[best].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(q_out, pa.int64()), pa.array(i_out, pa.int64()), pa.array(d_out, pa.float64())], names=["query_id", "item_id", "dist"])

        return step

    rank = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "item_id"))

    def ranked(held: list) -> DataFrame:
        part = table.mapInArrow(step_for(np.array([r.id for r in held]), [np.array(r.v) for r in held]), schema)
        return part.withColumn("rank", rank).where(F.col("rank") <= k)

    # one block stays lazy; of more, each is written before the next is sent out, so the driver holds one
    path, held = f"{scratch_dir(spark)}/nearest-{uuid.uuid4().hex}", []
    for row in asked.orderBy("id").toLocalIterator():
        if len(held) >= block and held[-1].id != row.id:
            ranked(held).write.mode("append").parquet(path)
            found, held = path, []
        held.append(row)
    if found is None:
        return ranked(held) if held else spark.createDataFrame([], schema + ", rank int")
    ranked(held).write.mode("append").parquet(path)
    return spark.read.parquet(path)
