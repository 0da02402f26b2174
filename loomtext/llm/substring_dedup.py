r"""Exact substring deduplication by difference-cover anchors.

A window is ``window`` consecutive words of one document; each word covered by a window whose word
sequence also starts earlier (smaller doc_id, or earlier in the same document) is removed.

Method: 8-word anchors are hashed only at positions p with p mod 13 in {0, 1, 3, 9}. That set is a
difference cover: for any two positions of an equal 20-word window some shift of up to 12
words puts both on it, and the 8 words from there still lie inside the window, so equal windows
share an aligned anchor. Anchors found twice or more send their documents' positions to the second
step, which extends them to the windows that hold them, digests these (96 bits, from a 128-bit digest of each word), and ranks
the holders of each digest. Any two different windows among 10^13 have equal digests with a chance under 10^-3.

Scale: documents are dealt once into chunks of about ``chunk_bytes`` by a hash of the text, salted for
texts with many copies or many bytes in copies, so no chunk grows with them; this one exchange of the text serves all three passes.
Anchors travel as (hash, chunk), one row per chunk however often
it has them; windows as one row per chunk, the chunk's earliest, since later ones in the chunk are
removed at once. So a passage in a third of all documents is one narrow row per chunk (of 4 MiB of text), ranked by a
window that spills; that is less than an average task has where chunks outnumber the words of one. Only shared anchors and repeated windows travel back.

Edge cases: null and empty texts have no words; texts below 20 words lose nothing; rows that repeat
a doc_id count as one document, so equal positions of them don't remove one another; null ids
rank last. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.llm.text import plain_words

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
CHUNK_BYTES = 4 << 20
SALT_COPIES = 64
SALT_CHUNKS = 8
MOST_SALTED = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Digests(dict):
    """Word to its number, with the two halves of each word's 128-bit digest."""

    def __init__(self) -> None:
        super().__init__()
        self.high, self.low = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        digest = xxhash.xxh3_128_intdigest(word)
        self.high.append(digest >> 64)
        self.low.append(digest & 0xFFFFFFFFFFFFFFFF)
        self[word] = n = len(self)
        return n


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolled(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ``length``-word windows, by doubling: two halves make a whole."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, size = None, 0, words, 1
    while True:
        if length & size:
            part = power[done : done + n]
            out = part.copy() if out is None else _mixed(out * _BASE + part)
            done += size
        size *= 2
        if size > length:
            return _mixed(out + np.uint64(length))
        power = _mixed(power[: len(power) - size // 2] * _BASE + power[size // 2 :])


def _cover_positions(n: int, anchor: int) -> np.ndarray:
    starts = np.arange(0, max(0, n - anchor + 1))
    return starts[np.isin(starts % PERIOD, COVER)]


class _Chunk:
    """The documents of one chunk in a fixed order, with word hashes."""

    def __init__(self, table: pa.Table) -> None:
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, texts[i] is not None, texts[i] or b""))
        self.ids = [ids[i] for i in order]
        self.words = [plain_words(texts[i]) for i in order]
        digests = _Digests()
        numbers = [np.fromiter(map(digests.__getitem__, w), dtype=np.int32, count=len(w)) for w in self.words]
        high, self._low, self._numbers = np.array(digests.high, np.uint64), np.array(digests.low, np.uint64), numbers
        self.hashes = [high[n] for n in numbers]

    def windows(self, i: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the digests of all windows of a document."""
        return _rolled(self.hashes[i], length), _rolled(self._low[self._numbers[i]], length) >> np.uint64(32)

    def anchors(self, anchor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, h in enumerate(self.hashes):
            at = _cover_positions(len(h), anchor)
            if len(at):
                yield i, at, _rolled(h, anchor)[at]


def _anchor_rows(key: tuple, table: pa.Table, anchor: int) -> pa.Table:
    found = [h for _, _, h in _Chunk(table).anchors(anchor)]
    values, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
    return pa.table({"h": values.view(np.int64), "chunk": pa.array(np.full(len(values), key[0].as_py(), np.int64)), "n": pa.array(np.minimum(counts, 2).astype(np.int32))})


def _window_rows(key: tuple, table: pa.Table, shared: pa.Table, window: int, anchor: int) -> pa.Table:
    """Rows for the windows around shared anchors: the chunk's earliest holders (digest h and g, doc_id, at; more is
    -1), and the later ones, which are known to go, as runs (first window, how many more).

    ``at`` is the row in the chunk and the start. Rows leave in that order, which packs well."""
    names = ["h", "g", "doc_id", "chunk", "at", "more"]
    chunk = _Chunk(table)
    known = np.sort(shared["h"].to_numpy().view(np.uint64)) if shared.num_rows else np.empty(0, np.uint64)
    hs, gs, rows, starts = [], [], [], []
    if len(known):
        for i, at, h in chunk.anchors(anchor):
            hit = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            n = len(chunk.hashes[i]) - window + 1
            if n <= 0 or not len(hit):
                continue
            # windows that hold an anchor start 0 to window-anchor words before it
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, np.clip(hit - (window - anchor), 0, n), 1)
            np.add.at(edge, np.clip(hit + 1, 0, n), -1)
            start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            high, low = chunk.windows(i, window)
            hs.append(high[start])
            gs.append(low[start])
            rows.append(np.full(len(start), i, np.int32))
            starts.append(start.astype(np.int32))
    h, g = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (hs, gs))
    row = np.concatenate(rows) if rows else np.empty(0, np.int32)
    start = np.concatenate(starts) if starts else np.empty(0, np.int32)
    # rows of one doc_id stand together; a place equal to the first's (id, start) isn't later
    ident = np.cumsum([0] + [int(a != b or a is None) for a, b in zip(chunk.ids, chunk.ids[1:], strict=False)])
    order = np.lexsort((start, ident[row], g, h))
    h, g, row, start = h[order], g[order], row[order], start[order]
    lead = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0)) if len(h) else np.empty(0, np.int64)
    late = (ident[row] != ident[row[first]]) | (start != start[first])
    lr, ls = row[late], start[late]
    order = np.lexsort((ls, lr))
    lr, ls = lr[order], ls[order]
    cut = np.flatnonzero((lr[1:] != lr[:-1]) | (ls[1:] != ls[:-1] + 1)) + 1
    a = np.concatenate(([0], cut)).astype(np.int64) if len(ls) else np.empty(0, np.int64)
    z = np.concatenate((cut, [len(ls)])).astype(np.int64) - 1 if len(ls) else np.empty(0, np.int64)
    fr, fs, fh, fg = row[~late], start[~late], h[~late], g[~late]
    order = np.lexsort((fs, fr))
    fr, fs, fh, fg = fr[order], fs[order], fh[order], fg[order]
    out_row = np.concatenate((fr, lr[a])).astype(np.int64)
    at = out_row << 32 | np.concatenate((fs, ls[a])).astype(np.int64)
    more = np.concatenate((np.full(len(fr), -1), ls[z] - ls[a])).astype(np.int32)
    # a run that only needs to get home is dealt by its place
    out_h = np.concatenate((fh, _mixed(at[len(fr) :].view(np.uint64) + np.uint64(key[0].as_py())))).view(np.int64)
    out_g = np.concatenate((fg, np.zeros(len(a), np.uint64))).astype(np.uint32).view(np.int32)
    id_type = table.schema.field("doc_id").type
    ids = pa.array(chunk.ids, id_type).take(pa.array(out_row)) if len(out_row) else pa.array([], id_type)
    return pa.table([pa.array(out_h), pa.array(out_g), ids, pa.array(np.full(len(out_row), key[0].as_py(), np.int64)), pa.array(at), pa.array(more)], names=names)


def _kept_rows(table: pa.Table, removed: pa.Table, window: int, with_text: bool) -> pa.Table:
    chunk = _Chunk(table)
    at, more = removed["at"].to_numpy(), removed["more"].to_numpy()
    row, start = at >> 32, at & 0xFFFFFFFF
    end = start + np.maximum(more, 0)
    order = np.argsort(row, kind="stable")
    row, start, end = row[order], start[order], end[order]
    edges = np.searchsorted(row, np.arange(len(chunk.ids) + 1))
    n_words, n_removed, digests, kept_texts = [], [], [], []
    for i, words in enumerate(chunk.words):
        own = slice(edges[i], edges[i + 1])
        kept = words
        if own.start < own.stop:
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, start[own], 1)
            np.add.at(edge, end[own] + window, -1)
            kept = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        text = b" ".join(kept)
        n_words.append(len(words))
        n_removed.append(len(words) - len(kept))
        digests.append(hashlib.sha256(text).hexdigest())
        kept_texts.append(text if with_text else None)
    out = {"doc_id": pa.array(chunk.ids, table.schema.field("doc_id").type), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    if with_text:
        out["kept_text"] = pa.array(kept_texts, pa.binary())
    return pa.table(out)


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space (and kept_text, if asked for)."""
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"window must be {PERIOD} words or more")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    key = F.xxhash64("text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    chunks = max(1, -(-total[0] // chunk_bytes))
    # Copies of a text share a chunk, so their windows leave it once. Texts with more than ``many`` copies, or more than ``much`` bytes in
    # copies, are salted; by the second terms of both bounds there are fewer than 2 x MOST_SALTED of them.
    many = max(SALT_COPIES, -(-total[1] // MOST_SALTED))
    much = max(SALT_CHUNKS * chunk_bytes, -(-total[0] // MOST_SALTED))
    copies = rows.groupBy(key.alias("of")).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("size"))
    copies = copies.where((F.col("n") > 1) & ((F.col("n") > many) | (F.col("n") * F.col("size") > much)))
    salted = copies.select("of", F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / many), F.ceil(F.col("n") * F.col("size") / much))).alias("salts"))
    dealt = rows.withColumn("key", key).join(F.broadcast(salted), F.col("key") == F.col("of"), "left")
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)))
    dealt = dealt.select("doc_id", "text", F.pmod(F.xxhash64("key", salt), F.lit(chunks)).alias("chunk"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    anchors = dealt.groupBy("chunk").applyInArrow(lambda key, t: _anchor_rows(key, t, anchor), "h long, chunk long, n int")
    both = W.partitionBy("h")
    shared = anchors.withColumn("total", F.sum("n").over(both)).where("total > 1").select("chunk", "h")

    schema = f"h long, g int, doc_id {id_type}, chunk long, at long, more int"
    windows = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(lambda key, t, s: _window_rows(key, t, s, window, anchor), schema)
    known = F.col("more") >= 0
    rank = F.rank().over(W.partitionBy("h", "g", known).orderBy(F.col("doc_id").asc_nulls_last(), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))))
    removed = windows.withColumn("rank", rank).where(known | (F.col("rank") > 1)).select("chunk", "at", "more")

    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text
    return dealt.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(lambda key, t, r: _kept_rows(t, r, window, with_text), schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(g, ' ')) ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, count(gone.p) AS n, coalesce(string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL), '') AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
