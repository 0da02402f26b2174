r"""Near-duplicates by SimHash and, past its bits, by the shingle sets themselves: complete and exact at Jaccard similarity 0.8.

Texts with equal sets of word shingles are one class. A class has the SimHash fingerprint of its set; fingerprints that
link at ``simhash_dedup.THRESHOLD`` bits are found by anchors, and each link is verified on the sets, so that only pairs at 0.8 or more count.

Near texts can lie further apart than those bits, so a search on the sets follows, which is complete by itself. Two sets x, y at 4/5 or more differ in at most |x|/4 elements
(|x| <= |y|), and |y| is in the size level of x or the next one. Per level, hashes are cut by value into so many
parts that even with that many differences some parts are equal, and more of them than are empty in x or y; a class
emits one signature per non-empty part for its own level and the one below. A set with too many empty parts for
this also emits its prefix (the least n - ceil(4n/5) + 1 hashes), on which two such sets meet. So every
pair at 0.8 shares a signature. Pairs are then verified on the sets themselves.

Round 1 verifies each member of a signature against the least one and forms components. Round 2 verifies the
remaining pairs whose ends are in different components, so a group of copies costs a star, not all pairs; nor does a round verify pairs
that links before it joined.
Members of one signature that stay in different components are all held against each other, but only by size and by
``BITS`` parities: these differ in at most as many bits as the sets in elements, so what they rule out is never near,
and few pairs leave the task to be verified. Those comparisons grow with the square of such a group.

Disk: at most the rows of the classes and one more step's exchange lie there at a time, since steps are written, their exchanges
go when they end, and narrow tables are deleted after their last use.

Edge cases: null and empty texts are one class; a text under ``SHINGLE`` words is one shingle; sets are of 64-bit
hashes and classes are named by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.sketches import splitmix
from loomtext.llm import simhash_dedup
from loomtext.llm.components import connected_components
from loomtext.llm.text import lower_words
from loomtext.session import discard, materialise

SHINGLE = 5
BITS = 1024
_PREFIX = np.uint64(0x5851F42D4C957F2D)
LEVELS = [1]
while LEVELS[-1] < 1 << 40:
    LEVELS.append(LEVELS[-1] * 5 // 4 + 1)


def shingle_set(raw: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the lower-cased text's word shingles."""
    words = lower_words(raw)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SHINGLE)], np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    out = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        out = splitmix(out ^ w[j : j + len(out)])
    return np.unique(out)


def is_near(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of 4/5 or more, in whole numbers."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * shared >= 4 * (len(x) + len(y) - shared)


def parities(x: np.ndarray) -> np.ndarray:
    """Bit b is set if an odd number of hashes fall on b."""
    odd = np.bincount((splitmix(x) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def may_be_near(n: np.ndarray, bits: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """False only for pairs under 4/5: sets at 4/5 differ in at most a ninth of their sizes' sum."""
    apart = np.bitwise_count(bits ^ others).sum(axis=-1, dtype=np.int64)
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * apart <= n + m)


def parts_of(level: int) -> tuple[int, int]:
    """(parts, empty parts that a set may have) for pairs whose smaller set is in ``level``."""
    differ = (LEVELS[level + 1] - 1) // 4
    spare = 3 + differ // 10 if differ else 0
    return differ + 1 + spare, spare


def signatures(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    level = int(np.searchsorted(LEVELS, len(x), side="right")) - 1
    mixed, out, sparse = splitmix(x), [], False
    for label in range(max(0, level - 1), level + 1):
        k, spare = parts_of(label)
        part = ((x >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascends with x
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out.append(splitmix(np.add.reduceat(mixed, start) ^ splitmix((np.uint64(label) << np.uint64(40)) ^ part[start])))
        sparse |= k - len(start) > spare
    if sparse:
        out.append(splitmix(x[: len(x) - (4 * len(x) + 4) // 5 + 1] ^ _PREFIX))
    return np.concatenate(out)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a class: _node, _fp, _rank, _text and the whole row _doc with the least id (null last) and text hash."""

    def sketches(text: pa.Array) -> pa.Array:
        sets = [shingle_set(x.as_py()) for x in text]
        found = [[xxhash.xxh64_intdigest(x.tobytes()) for x in sets], [simhash_dedup.fold(x) for x in sets]]
        return pa.StructArray.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in found], names=["node", "fp"])

    keyed = docs.select(
        F.arrow_udf(sketches, "struct<node:long,fp:long>")(F.col(text_col).cast("binary")).alias("_set"),
        F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("_rank"),
        F.struct(*docs.columns).alias("_doc"),
    )
    firsts = keyed.groupBy("_set").agg(F.min("_rank").alias("_rank"), F.min_by("_doc", "_rank").alias("_doc"))
    return materialise(firsts.select(F.col("_set.node").alias("_node"), F.col("_set.fp").alias("_fp"), "_rank", "_doc"), "shingle-classes")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    if pa.types.is_binary(batch[name].type):
        return np.frombuffer(b"".join(batch[name].to_pylist()), np.uint64).reshape(len(batch), BITS // 64)
    return batch[name].to_numpy(zero_copy_only=False)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns cut at group ends (rows sorted by the first), with the starts of the groups."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [_column(batch, c) for c in names]
        cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
        start = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        held = [c[start[-1] :] for c in cols]
        if len(start) > 1:
            yield [c[: start[-1]] for c in cols], start[:-1]
    if held:
        yield held, np.zeros(1, np.int64)


def shared_signatures(texts: DataFrame) -> DataFrame:
    """(sig, node, least) of the signatures that two classes (_node, _text) or more have."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch["_node"].to_pylist(), batch["_text"], strict=True):
                found = signatures(shingle_set(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), node, np.int64))], names=["sig", "node"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sig, node), start in _groups(batches, ["sig", "node"]):
            size = np.diff(np.append(start, len(sig)))
            least = np.repeat(np.minimum.reduceat(node, start), size)
            many = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (sig, node, least)], names=["sig", "node", "least"])

    rows = texts.mapInArrow(emit, "sig long, node long").repartition("sig").sortWithinPartitions("sig")
    return materialise(rows.mapInArrow(fold, "sig long, node long, least long"), "shared-signatures")


def profiles(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, n, bits): size and parities of the classes in ``shared``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch["_text"]]
            yield pa.RecordBatch.from_arrays([batch["_node"], pa.array([len(x) for x in sets], pa.int64()), pa.array([parities(x).tobytes() for x in sets], pa.binary())], names=["node", "n", "bits"])

    some = texts.join(shared.select(F.col("node").alias("_node")).distinct(), "_node", "left_semi").select("_node", "_text")
    return materialise(some.mapInArrow(step, "node long, n long, bits binary"), "profiles")


def _likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) that sizes and parities don't rule out."""
    side = lambda end: known.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("bits").alias(f"{end}_bits"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = may_be_near(*(_column(batch, c) for c in ("u_n", "u_bits", "v_n", "v_bits")))
            yield batch.select(["u", "v"]).filter(pa.array(near))

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(step, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes at 0.8 or more."""
    pairs = materialise(pairs, "candidates")
    named = pairs.select(F.explode(F.array("u", "v")).alias("_node")).distinct()
    some = texts.join(named, "_node", "left_semi")
    both = pairs.join(some.select(F.col("_node").alias("u"), F.col("_text").alias("x")), "u").join(some.select(F.col("_node").alias("v"), F.col("_text").alias("y")), "v")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(shingle_set)
        for batch in batches:
            near = [is_near(known(x.as_py()), known(y.as_py())) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    near = materialise(both.mapInArrow(step, "u long, v long"), "near-pairs")
    discard(pairs)
    return near


def simhash_edges(texts: DataFrame) -> DataFrame:
    """(u, v) of classes (_node, _fp, _text) at 0.8 or more, among those that equal fingerprints or their links join."""
    least = materialise(texts.groupBy("_fp").agg(F.min("_node").alias("least")), "fingerprints")
    equal = texts.select("_node", "_fp").join(least, "_fp").where("_node <> least").select(F.col("least").alias("u"), F.col("_node").alias("v"))
    end = lambda name: least.select(F.col("_fp").alias(f"fp_{name}"), F.col("least").alias(name))
    linked = simhash_dedup.links(least.select(F.col("_fp").alias("fp"))).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v"))
    linked = linked.join(end("u"), "fp_u").join(end("v"), "fp_v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    near = verified(equal.unionAll(linked).distinct(), texts)
    discard(least)
    return near


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends aren't in one component (node, root)."""
    side = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    return pairs.join(side("u"), "u", "left").join(side("v"), "v", "left").where("u_root is null or v_root is null or u_root <> v_root").select("u", "v")




def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs within a signature whose ends are in different components, without those with the least member."""
    for (sig, node, least, root, n, bits), start in _groups(batches, ["sig", "node", "least", "root", "n", "bits"]):
        ends = np.append(start[1:], len(sig))
        mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        us, vs = [], []
        for a, b in zip(start[mixed].tolist(), ends[mixed].tolist(), strict=True):
            rest = np.arange(a, b)[node[a:b] != least[a]]
            for at in range(1, len(rest)):
                i, other = rest[at], rest[:at]
                other = other[(root[other] != root[i]) & may_be_near(n[i], bits[i], n[other], bits[other])]
                us.append(np.minimum(node[other], node[i]))
                vs.append(np.maximum(node[other], node[i]))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def near_edges(texts: DataFrame) -> DataFrame:
    """(u, v): verified edges with the components of all pairs of classes (_node, _fp, _text) at 0.8 or more."""
    linked = simhash_edges(texts)
    shared = shared_signatures(texts)
    known = profiles(texts, shared)
    pairs = _likely(shared.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct(), known)
    stars = linked.unionAll(verified(_apart(pairs, connected_components(linked)), texts))
    rooted = shared.join(connected_components(stars), "node", "left").join(known, "node").select("sig", "node", "least", F.coalesce("root", "node").alias("root"), "n", "bits")
    left = rooted.repartition("sig").sortWithinPartitions("sig").mapInArrow(_across, "u long, v long").distinct()
    edges = stars.unionAll(verified(left, texts))
    discard(shared)
    discard(known)
    return edges


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of texts at 0.8 or more: that with the smallest id, null last, then by the text's hash.

    Rows are told apart by their text, so rows that repeat an id or have none take part like any other. Columns stay.
    """
    classes = _classes(docs, id_col, text_col)
    texts = classes.select("_node", "_fp", F.col(f"_doc.`{text_col}`").cast("binary").alias("_text"))
    roots = connected_components(near_edges(texts))
    ranked = roots.withColumnRenamed("node", "_node").join(classes.select("_node", "_rank"), "_node")
    best = ranked.groupBy("root").agg(F.min(F.struct("_rank", "_node")).alias("best"))
    gone = ranked.join(best, "root").where(F.col("_node") != F.col("best._node")).select("_node")
    return classes.join(gone, "_node", "left_anti").select("_doc.*")
