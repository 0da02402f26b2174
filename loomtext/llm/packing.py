"""Best-two-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

A bin is filled greedily with the largest documents that fit; if a gap remains, its smallest document is
replaced by the two unpacked documents that fill the expanded gap most tightly, if they fill it better.

Scale: lengths are whole numbers up to the capacity, so the plan needs only how many pieces have each length.
Equal bins are planned together, which makes the plan a bounded table (some thousand rows for 1024
tokens, whatever the corpus) of (length, range of ranks, first sequence, offset). A full piece is a sequence by itself and
isn't ranked. Other pieces get their rank within their length from hash buckets of about ``BUCKET_ROWS`` pieces, or more
where there would be over ``MOST_BUCKETS``, so a length that a
third of all pieces has is ranked by many tasks. The tables of bucket starts (``MOST_BUCKETS`` + ``capacity`` numbers at most) and of
the plan are broadcast to the tasks, which look ranks up by bisection. Texts are never
shuffled, ids only if asked for.

Edge cases: a null or empty text is its end token alone; longer documents are cut into full pieces, the
first of which may be shorter; strings of added tokens in a text become their ids, as in the tokenizers library;
repeated rows are packed each; null ids are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomtext.llm import bpe
from loomtext.session import materialise

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 200
MOST_BUCKETS = 100_000


def _fill(sizes: list[int], free: dict[int, int], gap: int) -> list[int]:
    """Sizes taken greedily, largest first; ``sizes`` ascending."""
    taken: list[int] = []
    used: Counter[int] = Counter()
    at = len(sizes)
    while gap and at:
        at = min(at, bisect_right(sizes, gap))
        while at and free[sizes[at - 1]] <= used[sizes[at - 1]]:
            at -= 1
        if at:
            s = sizes[at - 1]
            k = min(gap // s, free[s] - used[s])
            taken += [s] * k
            used[s] += k
            gap -= s * k
    return taken


def _tighter_pair(sizes: list[int], free: dict[int, int], used: Counter, least: int, room: int) -> tuple[int, int] | None:
    """The two free sizes with the largest sum over ``least`` and up to ``room``."""
    best, pair = least, None
    low, high = 0, bisect_right(sizes, room) - 1
    while low <= high:
        x, y = sizes[low], sizes[high]
        left = lambda s: free[s] - used[s]
        if left(y) < 1:
            high -= 1
        elif left(x) < (2 if low == high else 1):
            low += 1
        elif x + y > room:
            high -= 1
        else:
            if x + y > best:
                best, pair = x + y, (y, x)
            low += 1
    return pair


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (sizes, how many such bins), together holding the histogram exactly."""
    free = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in free):
        raise ValueError("lengths must be between 1 and the capacity")
    out = []
    while free:
        sizes = sorted(free)
        taken = _fill(sizes, free, capacity)
        gap = capacity - sum(taken)
        if gap:
            used = Counter(taken)
            used[taken[-1]] -= 1
            if pair := _tighter_pair(sizes, free, used, taken[-1], taken[-1] + gap):
                taken = [*taken[:-1], *pair]
        used = Counter(taken)
        times = min(free[s] // k for s, k in used.items())
        out.append((taken, times))
        for s, k in used.items():
            free[s] -= k * times
            if not free[s]:
                del free[s]
    return out


def _slots(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) of every slot of the plan, sorted."""
    rank: Counter[int] = Counter()
    rows, sequence = [], 0
    for sizes, times in bins:
        at = 0
        for s in sizes:
            rows.append((s, rank[s], sequence, at))
            rank[s] += times
            at += s
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, model: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = end_id.to_bytes(4, "little")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(model).id_bytes
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                raw = memoryview(encode(text.as_py()) + end)
                n = len(raw) // 4
                at, k = 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 else capacity
                    part = raw[4 * at : 4 * (at + size)]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    at, k = at + size, k + 1
            arrays = [batch["doc_id"].take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, model: str | None = None, bucket_rows: int = BUCKET_ROWS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity=capacity, end_id=end_id, model=model, with_ids=with_ids, id_col=id_col, text_col=text_col), "pieces")
    # the rows that were written stand in the same places whenever they are read, so these numbers are the same in a repeated task
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < capacity)
    lengths = rest.groupBy("length").count().toArrow()  # at most ``capacity`` rows
    rows = np.asarray(lengths["count"])
    most = max(bucket_rows, int(rows.sum()) // MOST_BUCKETS)
    few = spark.createDataFrame(pa.table({"of": lengths["length"], "buckets": pa.array(-(-rows // most), pa.int64())}))
    dealt = rest.join(F.broadcast(few), F.col("length") == F.col("of")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    key = dealt.select(*cut.columns, "bucket")
    counts = key.groupBy("length", "bucket").count().toArrow().sort_by([("length", "ascending"), ("bucket", "ascending")])
    length, bucket, count = (counts[c].to_numpy().astype(np.int64) for c in ("length", "bucket", "count"))
    before = np.cumsum(count) - count
    lead = np.concatenate(([True], length[1:] != length[:-1])) if len(length) else np.empty(0, bool)
    base = before - before[lead][np.cumsum(lead) - 1]  # ranks that earlier buckets of the length take
    histogram = dict(zip(length[lead].tolist(), np.add.reduceat(count, np.flatnonzero(lead)).tolist(), strict=True)) if len(length) else {}
    slots = _slots(plan(histogram, capacity))
    edges = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((slots, edges, length << 32 | bucket, base))
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = key.withColumn("nth", F.row_number().over(order).cast("long") - 1)
    kept = cut.columns
    names = [*kept, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, edges, known, base = shared.value
        for batch in batches:
            first, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            lengths, buckets, nth = (batch[c].to_numpy() for c in ("length", "bucket", "nth"))
            turn = np.flatnonzero(np.concatenate(([True], (lengths[1:] != lengths[:-1]) | (buckets[1:] != buckets[:-1])))) if len(batch) else []
            for a, z in zip(turn, [*turn[1:], len(batch)], strict=True):
                s = int(lengths[a])
                own = slots[edges[s] : edges[s + 1]]
                rank = base[np.searchsorted(known, s << 32 | int(buckets[a]))] + nth[a:z]
                at = np.searchsorted(own[:, 1], rank, side="right") - 1
                first[a:z] = own[at, 2] + rank - own[at, 1]
                offset[a:z] = own[at, 3]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(first), pa.array(offset)], names=names)

    placed = ranked.mapInArrow(place, StructType([*cut.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    out = placed.unionAll(full.select(*names))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
