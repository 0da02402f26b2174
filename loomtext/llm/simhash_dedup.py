r"""Near-duplicates by SimHash, found with an anchor-point covering.

A fingerprint has bit b set if over half of the text's shingle hashes have it. Two fingerprints
link at ``threshold`` or fewer differing bits. The 64 bits are cut into (threshold+1)/2 blocks, so
linked fingerprints differ in at most one bit in some block. In each block a covering code gives
the anchors: a perfect Hamming code on 2^r-1 bits and all values on the spare bits, with covering
radius 1. A value's home is its nearest anchor; it is replicated to every anchor within the
radius plus one. If two values differ in one bit at most, each is present at the other's home, so
comparing homes with visitors at each anchor finds every link.

Scale: only distinct fingerprints are replicated, 34 narrow rows each at threshold 3, so a third of
all documents being copies is one fingerprint. At an anchor, links are folded into a spanning
forest while rows stream by, hence at most one edge per row leaves, not one per pair. Anchors with over
``block_rows`` homes are dealt into chunks of homes, each compared with all visitors in its own
task, so memory is bounded and nothing is skipped. Their table is broadcast: a fingerprint has one home a block of bits, and
``block_rows`` grows with the fingerprints, so it has ``MOST_CROWDED`` rows a block of bits at most. Components come from ``components``. Rows get their component by fingerprint:
those of crowded fingerprints from a bounded broadcast table (``spread``), so no task gets all copies of a text.

Edge cases: null and empty texts have fingerprint zero and link like any other; repeated
rows are one fingerprint; a null doc_id never names a component unless all of it is null (then null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.components import connected_components
from loomtext.llm.spread import HOT_ROWS, spread_join
from loomtext.llm.text import lower_words
from loomtext.session import materialise

SHINGLE = 3
THRESHOLD = 3
SEED = 42
BLOCK_ROWS = 1 << 14
MOST_CROWDED = 500_000
_PIECE = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased text's word shingles, repeats included."""
    words = lower_words(raw)
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return fold(np.array([digest(g, SEED) for g in grams], dtype="<u8"))


def fold(hashes: np.ndarray) -> int:
    """The bits that over half of the unsigned 64-bit hashes have; no hashes give zero."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _PIECE):
        votes += np.unpackbits(hashes[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


class Covering:
    """The covering code of one block of bits: offsets from a value to its anchors, home first."""

    def __init__(self, width: int) -> None:
        r = (width + 1).bit_length() - 1
        self.parities = [sum(1 << (p - 1) for p in range(1, 1 << r) if p >> j & 1) for j in range(r)]
        spare = [1 << b for b in range((1 << r) - 1, width)]
        unit = lambda p: 1 << (p - 1) if p else 0
        table = []
        for s in range(1 << r):
            near = [unit(s)] + [unit(a) ^ unit(a ^ s) for a in range(1, 1 << r) if s and a < a ^ s]
            table.append(near + [unit(s) ^ b for b in spare])
        self.lengths = np.array([len(t) for t in table])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.offsets = np.array([x for t in table for x in t], dtype=np.uint64)

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, anchors, and whether each is the row's home."""
        syndrome = np.zeros(len(values), dtype=np.int64)
        for j, mask in enumerate(self.parities):
            syndrome |= (np.bitwise_count(values & np.uint64(mask)).astype(np.int64) & 1) << j
        n = self.lengths[syndrome]
        rows = np.repeat(np.arange(len(values)), n)
        first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
        nth = np.arange(len(rows)) - np.repeat(first, n)
        return rows, values[rows] ^ self.offsets[np.repeat(self.starts[syndrome], n) + nth], nth == 0


def bit_blocks(threshold: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks: so many that ``threshold`` differences leave one with at most one."""
    m = max(1, (threshold + 2) // 2)
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def replicate(distinct: DataFrame, threshold: int = THRESHOLD, only_home: bool = False) -> DataFrame:
    """(block, anchor, fp, home) for distinct fingerprints ``fp``."""
    blocks = [(s, w, Covering(w)) for s, w in bit_blocks(threshold)]
    names = ["block", "anchor", "fp", "home"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (shift, width, code) in enumerate(blocks):
                part = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                rows, anchor, home = code.anchors(part)
                if only_home:
                    rows, anchor, home = rows[home], anchor[home], home[home]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, dtype=np.int32)), pa.array(anchor.view(np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(home)], names=names)

    return distinct.select("fp").mapInArrow(step, "block int, anchor long, fp long, home boolean")


def _forest_edges(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of the links at each anchor; rows come sorted by anchor, homes first."""
    key, homes, label = None, np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        block, anchor, chunk = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "anchor", "chunk"))
        fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
        home = batch["home"].to_numpy(zero_copy_only=False)
        new = np.concatenate(([True], (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1]))) if len(fps) else np.empty(0, bool)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fps)))
        n_home = np.add.reduceat(home.astype(np.int64), start) if len(start) else start
        # a group inside the batch with one row or no home has no pair
        open_ends = np.zeros(len(start), dtype=bool)
        open_ends[:1] = open_ends[-1:] = True
        us, vs = [], []
        for g in np.flatnonzero(open_ends | ((size > 1) & (n_home > 0))).tolist():
            a, b = int(start[g]), int(start[g] + size[g])
            this = (block[a], anchor[a], chunk[a])
            if this != key:
                key, homes, label = this, np.empty(0, np.uint64), np.empty(0, np.int64)
            homes = np.concatenate((homes, fps[a:b][home[a:b]]))
            label = np.concatenate((label, np.arange(len(label), len(homes))))  # the tree that each home is in
            for at in range(a, b, 1024):
                part = fps[at : min(b, at + 1024)]
                # homes come first and may follow in later batches, so a home is also held against later homes
                near = np.bitwise_count(part[:, None] ^ homes[None, :]) <= threshold if len(homes) else np.zeros((len(part), 0), bool)
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    hit = np.flatnonzero(near[i])
                    trees = label[hit]
                    if trees.min() == trees.max():
                        # a home is in that tree already, a visitor joins it by one edge
                        ends = [] if home[at + i] else hit[:1]
                    else:
                        found, first = np.unique(trees, return_index=True)
                        label[np.isin(label, found)] = found[0]
                        ends = hit[first]
                    for j in ends:
                        if part[i] != homes[j]:
                            us.append(int(part[i]))
                            vs.append(int(homes[j]))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(us, np.uint64).view(np.int64)), pa.array(np.array(vs, np.uint64).view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, threshold: int = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): edges between distinct fingerprints with the components of all links."""
    block_rows = max(block_rows, distinct.count() // MOST_CROWDED)
    rep = replicate(distinct, threshold)
    crowded = replicate(distinct, threshold, only_home=True).groupBy("block", "anchor").count().where(F.col("count") > block_rows)
    crowded = crowded.select("block", "anchor", F.ceil(F.col("count") / block_rows).cast("int").alias("chunks"))
    rep = rep.join(F.broadcast(crowded), ["block", "anchor"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # a home lies in one chunk and visits the others
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = rep.withColumn("own", own).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("block", "anchor", "chunk", "fp", (F.col("home") & (F.col("own") == F.col("chunk"))).alias("home"))
    order = dealt.repartition("block", "anchor", "chunk").sortWithinPartitions("block", "anchor", "chunk", F.col("home").desc())
    return order.mapInArrow(lambda batches: _forest_edges(batches, threshold), "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fp (signed long), component_id (the smallest doc_id reachable by links)."""
    rows = materialise(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    roots = connected_components(links(classes, threshold, block_rows))
    rooted = classes.join(roots, classes.fp == roots.node).select("fp", "first", "root")
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    moved = rooted.join(named, "root").select("fp", "component")
    named_classes = materialise(classes.join(moved, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id")), "components")
    return spread_join(rows, named_classes, ["fp"], "n", HOT_ROWS).select("doc_id", "fp", "component_id")


def near_duplicate_report(docs: DataFrame, **params: int) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs, **params).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``shingle_dedup.drop_near_duplicates``, which takes its first candidates from the links of this module."""
    from loomtext.llm import shingle_dedup

    return shingle_dedup.drop_near_duplicates(docs, id_col=id_col, text_col=text_col)
