"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items become one generalised suffix automaton over word ids; documents
stream through it, which gives at each word the longest suffix that occurs in some item.
A window is ``window`` consecutive item words (a shorter item is one window). A document word
inside an occurrence of a window is hit.

Scale: documents are only mapped, never shuffled. The automaton lies in flat arrays, measured at about 24 bytes for each byte of
items while it is built on the driver and 12 when it is broadcast. The benchmark is dealt into blocks of at most about
``block_bytes`` of text by a hash of its id, so both are bounded (a single item is never cut); documents pass once through each
block. One block is the usual case; with more, each pass is written to the shared folder, so no task holds two automata.

Edge cases: a null or empty text has no words and no hits. Benchmark rows without an id or
without words give no windows; an empty benchmark hits nothing. Rows that repeat an item id count as one item. Repeated document
rows are each answered. A row travels as one struct, so columns of any name can't clash with those made here.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.text import FOLD, folded_words
from loomtext.session import materialise

WINDOW = 8
BLOCK_BYTES = 8 << 20
_PAIR_BITS = 22
_MULTIPLIER = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class _Transitions:
    """(state, word) to state in two flat arrays, by open addressing; 0 is no state, since nothing leads to the root."""

    def __init__(self, bits: int = 10) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.to = array("Q", bytes(8 << bits)), array("I", bytes(4 << bits))

    def _place(self, key: int) -> int:
        keys, mask = self.keys, (1 << self.bits) - 1
        at = (key * _MULTIPLIER & _M64) >> (64 - self.bits)
        while (k := keys[at]) and k != key:
            at = (at + 1) & mask
        return at

    def get(self, state: int, word: int) -> int:
        return self.to[self._place((state << 32 | word) + 1)]

    def put(self, state: int, word: int, to: int) -> bool:
        """Whether the transition is new."""
        key = (state << 32 | word) + 1
        at = self._place(key)
        new = not self.keys[at]
        self.keys[at], self.to[at] = key, to
        if new:
            self.n += 1
            if self.n * 10 > 7 << self.bits:
                self._grow()
        return new

    def _grow(self) -> None:
        keys, to = self.keys, self.to
        self.bits += 1
        self.keys, self.to = array("Q", bytes(8 << self.bits)), array("I", bytes(4 << self.bits))
        for i, key in enumerate(keys):
            if key:
                at = self._place(key)
                self.keys[at], self.to[at] = key, to[i]


class ItemAutomaton:
    """Generalised suffix automaton of items, with the items of each window class."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = self.shortest = window
        self.ids = _Ids()
        self.next = _Transitions()
        self.link, self.length = array("i", [-1]), array("i", [0])
        # a state's transitions as a list, for clones
        self._first, self._after, self._word = array("i", [-1]), array("i"), array("i")
        self.items: list[str] = []
        self.pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        number: dict[str, int] = {}
        whole: dict[int, set[int]] = {}
        ends, owners = array("i"), array("i")
        for item, words in items:
            if not words:
                continue
            if item not in number:
                number[item] = len(self.items)
                self.items.append(item)
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
            last = 0
            for n, w in enumerate(seq, 1):
                last = self._extend(last, w)
                if n >= window:
                    ends.append(last)
                    owners.append(number[item])
            if len(seq) < window:
                whole.setdefault(last, set()).add(number[item])
                self.shortest = min(self.shortest, len(seq))
            self.pairs[self._pair(np.asarray(seq, dtype=np.int64))] = True
        del self._first, self._after, self._word
        self._classes(np.asarray(ends), np.asarray(owners), whole)

    def _classes(self, ends: np.ndarray, owners: np.ndarray, whole: dict[int, set[int]]) -> None:
        """The states of windows with their items. A prefix of an item is the longest string of its state; its window class
        is the ancestor whose strings include the last ``window`` words. Short items end at the longest string of their state; states below reach them by links."""
        link, length, window = self.link, self.length, self.window
        self.top = array("i", bytes(4 * len(length)))
        self.short_here = {s: tuple(sorted(i)) for s, i in whole.items()}
        self.short = array("i", [-1]) * len(length) if whole else None
        for s in np.argsort(np.asarray(length), kind="stable")[1:].tolist():
            p = link[s]
            self.top[s] = self.top[p] if length[p] >= window else s
            if whole:
                self.short[s] = s if s in whole else self.short[p]
        tops = np.asarray(self.top)[ends].astype(np.int64) if len(ends) else np.empty(0, np.int64)
        both = np.unique(tops << 32 | owners.astype(np.int64)) if len(ends) else tops
        states, start = np.unique(both >> 32, return_index=True)
        self.window_states = array("q", states.tobytes())
        self.window_starts = array("q", np.append(start, len(both)).astype(np.int64).tobytes())
        self.window_items = array("i", (both & 0xFFFFFFFF).astype(np.int32).tobytes())

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.next.put(state, word, to):
            self._word.append(word)
            self._after.append(self._first[state])
            self._first[state] = len(self._word) - 1

    def _new(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self._first.append(-1)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        get, length = self.next.get, self.length
        if q := get(last, w):  # another item has this string already
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._new(length[last] + 1, 0)
        p = last
        while p != -1 and not get(p, w):
            self._lead(p, w, cur)
            p = self.link[p]
        if p != -1:
            q = get(p, w)
            self.link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.length[p] + 1, self.link[q])
        edge = self._first[q]
        while edge != -1:
            word = self._word[edge]
            self._lead(c, word, self.next.get(q, word))
            edge = self._after[edge]
        self.link[q] = c
        while p != -1 and self.next.get(p, w) == q:
            self.next.put(p, w, c)
            p = self.link[p]
        return c

    @staticmethod
    def _pair(ids: np.ndarray) -> np.ndarray:
        return (ids[:-1] * 2654435761 + ids[1:] * 40503 + 7) & ((1 << _PAIR_BITS) - 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit intervals [start, end) in words, and the items with occurring windows.

        Where two neighbouring words aren't neighbours in any item, the longest match has at most
        one word; the automaton is only stepped through the stretches between such places.
        """
        n = len(words)
        if not n or len(self.link) == 1:
            return [], set()
        ids = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=n)
        known = ids >= 0
        if self.shortest > 1:
            joined = known[:-1] & known[1:]
            joined &= self.pairs[self._pair(ids)]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
            begin, end = edge[::2], edge[1::2] + 1
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
            begin, end = edge[::2], edge[1::2]
        long_enough = end - begin >= self.shortest
        spans: list[tuple[int, int]] = []
        windows: set[int] = set()
        found: set[int] = set()
        for b, e in zip(begin[long_enough].tolist(), end[long_enough].tolist(), strict=True):
            self._stream(ids[b:e].tolist(), b, spans, windows, found)
        for s in windows:
            k = bisect_left(self.window_states, s)
            if k < len(self.window_states) and self.window_states[k] == s:
                found.update(self.window_items[self.window_starts[k] : self.window_starts[k + 1]])
        return _merged(spans), {self.items[i] for i in found}

    def _stream(self, ids: list[int], at: int, spans: list[tuple[int, int]], windows: set[int], found: set[int]) -> None:
        state, length, window, get = 0, 0, self.window, self.next.get
        for i, w in enumerate(ids, at):
            while not (to := get(state, w)) and state:
                state = self.link[state]
                length = self.length[state]
            if not to:
                length = 0
                continue
            state = to
            length += 1
            if length >= window:
                spans.append((i - length + 1, i + 1))
                windows.add(self.top[state])
            if self.short is not None:
                s = self.short[state]
                while s > 0:
                    m = self.length[s]
                    if m <= length:  # the state itself may stand for a shorter string than its longest
                        spans.append((i - m + 1, i + 1))
                        found.update(self.short_here[s])
                    s = self.short[self.link[s]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> list[Callable[[], Iterator]]:
    """The test items in blocks of about ``block_bytes`` of text; a block's items come to the driver one by one when it is called."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))

    def block(k: int) -> Iterator[tuple[str, list[bytes]]]:
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        return ((r.item, folded_words(r.text)) for r in part.toLocalIterator())

    return [lambda k=k: block(k) for k in range(blocks)]


_SPANS = "array<struct<s:int,e:int>>"


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Per document row: row (a struct of its columns), n (words), spans (start, end in words) and items; ``finish`` maps a
    batch of these to one with the column ``row`` alone."""
    spark: SparkSession = docs.sparkSession
    df = docs.select(F.struct(*docs.columns).alias("row"), F.lit(0).cast("long").alias("n"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    shared, blocks = None, item_blocks(benchmark, block_bytes)
    for k, items in enumerate(blocks):
        if shared:
            df = materialise(df, "decontaminate")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(ItemAutomaton(items(), window))
        last = finish if k == len(blocks) - 1 else None

        def step(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                n_words, all_spans, all_items = [], [], []
                texts = pc.struct_field(batch["row"], text_col).cast(pa.binary())
                for raw, spans, items in zip(texts, batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
                    words = folded_words(raw.as_py())
                    more, found = automaton.scan(words)
                    n_words.append(len(words))
                    all_spans.append([{"s": a, "e": b} for a, b in _merged([(x["s"], x["e"]) for x in spans] + more)] if more or spans else [])
                    all_items.append(sorted({*items, *found}))
                columns = [batch["row"], pa.array(n_words, pa.int64()), pa.array(all_spans, batch.schema.field("spans").type), pa.array(all_items, batch.schema.field("items").type)]
                batch = pa.RecordBatch.from_arrays(columns, names=["row", "n", "spans", "items"])
                yield last(batch) if last else batch

        df = df.mapInArrow(step, df.select("row").schema if last else df.schema)
    return df


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = 2, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (hex digest of the sorted, comma-joined ids), contaminated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    df = scan_documents(rows, benchmark, window=window, block_bytes=block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]))
    n_items = F.size("items").cast("long")
    return df.select("row.doc_id", F.col("n").alias("n_words"), hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"))


_WORD = re.compile(rb"[^\x20]+")


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the bytes from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"".join(out)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """Documents without benchmark spans: hit spans of more than ``max_span`` words are cut out of the
    text, and documents with more than ``max_coverage`` of their words hit are left out.
    Documents without hits pass unchanged, null and empty texts included. All columns stay."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows, n = {}, [], batch["n"].to_pylist()
        for i, spans in enumerate(batch["spans"].to_pylist()):
            if sum(x["e"] - x["s"] for x in spans) > max_coverage * n[i]:
                continue
            if long := [(x["s"], x["e"]) for x in spans if x["e"] - x["s"] > max_span]:
                texts[len(rows)] = cut_spans(pc.struct_field(batch["row"], text_col)[i].as_py().encode(), long)
            rows.append(i)
        row = batch["row"].take(pa.array(rows, pa.int64()))
        if texts:
            fields = [row.type.field(i) for i in range(row.type.num_fields)]
            columns = row.flatten()
            at = next(i for i, f in enumerate(fields) if f.name == text_col)
            columns[at] = pa.array([texts.get(i, x.as_py()) for i, x in enumerate(columns[at].cast(pa.binary()))], pa.binary()).cast(fields[at].type)
            row = pa.StructArray.from_arrays(columns, fields=fields)
        return pa.RecordBatch.from_arrays([row], names=["row"])

    return scan_documents(docs, benchmark, window=window, block_bytes=block_bytes, text_col=text_col, finish=cut).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM (SELECT item, w, least(len(w), 8) AS k, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(len(l), 0) >= 2 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
