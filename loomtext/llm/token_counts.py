"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A leaf is a run of pre-tokens with its length in characters and in tokens; inner nodes hold sums. An
edit finds its leaves by descending the character sums, re-encodes from the leaf that holds the
boundary context before the edit until a pre-token ends at an old leaf boundary after it, and
updates the sums on the leaves' paths. All other leaves keep their counts. Edits whose leaves touch are
re-encoded together.

A pre-token that ends ``context`` characters or more before an edit can't change: the pattern looks at most two
characters past its end, and added tokens (cut out first) have at most ``context``. After the edit, matching
depends only on what follows, so the first shared boundary ends the work.

Scale: a tree belongs to one row (two arrays), so building and editing are maps without shuffles; edits
come as an array on the document's row. Work on a row is linear in its text, its edits and its leaves.

Edge cases: null text is the empty text with no leaves; null or empty edit lists change nothing; edits
are in the positions of the text before any of them; bounds outside the text are clipped, an end before its start is
the start. An edit without a start or an end, or that overlaps one with a smaller (start, end) or equal ones
earlier in the list, is left out; insertions at one place are applied in the list's order; a null text
deletes. Repeated rows are answered each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import bpe

LEAF = 64
Edit = tuple[int, int, str]


class CountTree:
    """Character and token sums over leaves, as implicit binary trees."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = len(chars)
        self.size = 1 << max(0, (self.leaves - 1).bit_length())
        self.chars = self._built(chars)
        self.tokens = self._built(tokens)

    def _built(self, values: list[int]) -> list[int]:
        tree = [0] * self.size + values + [0] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            tree[i] = tree[2 * i] + tree[2 * i + 1]
        return tree

    @classmethod
    def of(cls, text: str, encoder: bpe.Encoder) -> CountTree:
        parts = encoder.pretokens(text)
        counts = encoder.counts(parts)
        cuts = range(0, len(parts), LEAF)
        return cls([sum(map(len, parts[i : i + LEAF])) for i in cuts], [sum(counts[i : i + LEAF]) for i in cuts])

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_arrays(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that aren't empty."""
        pairs = [(c, t) for c, t in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if c]
        return [c for c, _ in pairs], [t for _, t in pairs]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where it starts; the last leaf for the end."""
        node, start = 1, 0
        position = min(position, self.chars[1] - 1)
        while node < self.size:
            node *= 2
            if position - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        dc, dt = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, text: str, edit: Edit, encoder: bpe.Encoder) -> tuple[str, int]:
        """Applies one edit; the new text, and how many pre-tokens were encoded."""
        return self.edit_all(text, [edit], encoder)

    def edit_all(self, text: str, edits: list[Edit], encoder: bpe.Encoder) -> tuple[str, int]:
        """Applies edits in the positions of ``text``; the new text, and how many pre-tokens were encoded."""
        edits = settled(edits, len(text))
        if not text:
            new = "".join(e[2] for e in edits)
            tree = CountTree.of(new, encoder)
            self.leaves, self.size, self.chars, self.tokens = tree.leaves, tree.size, tree.chars, tree.tokens
            return new, len(encoder.pretokens(new))
        out, done, encoded, swaps, i = [], 0, 0, [], 0
        while i < len(edits):
            first, start = self.find(max(0, edits[i][0] - encoder.context))
            leaf, end, taken, step, more = first, start, i, 1, 1
            while True:
                # leaves for all edits that reach into them, and ``more`` leaves where no boundary was shared
                while leaf < self.leaves and (more or (taken < len(edits) and edits[taken][0] - encoder.context < end) or (taken and end < edits[taken - 1][1])):
                    end += self.chars[self.size + leaf]
                    leaf += 1
                    more -= more > 0
                    while taken < len(edits) and edits[taken][0] - encoder.context < end:
                        taken += 1
                new = _applied(text, start, end, edits[i:taken])
                parts = encoder.pretokens(new + text[end : end + encoder.context])
                at, n = 0, 0
                while n < len(parts) and at < len(new):
                    at += len(parts[n])
                    n += 1
                if at == len(new) or leaf == self.leaves:
                    break
                more = step = 2 * step
            parts = parts[:n]
            encoded += len(parts)
            swaps.append((first, leaf, parts))
            out += [text[done:start], new]
            done, i = end, taken
        out.append(text[done:])
        self._swap(swaps, encoder)
        return "".join(out), encoded

    def _swap(self, swaps: list[tuple[int, int, list[str]]], encoder: bpe.Encoder) -> None:
        """Puts new pre-tokens in the place of leaves: on their paths, or in a new tree where there are too many for them."""
        if all(len(parts) <= 4 * LEAF * (leaf - first) for first, leaf, parts in swaps):
            for first, leaf, parts in swaps:
                each = -(-len(parts) // (leaf - first))
                for k in range(leaf - first):
                    part = parts[k * each : (k + 1) * each]
                    self.set(first + k, sum(map(len, part)), sum(encoder.counts(part)))
            return
        chars, tokens, at = [], [], 0
        for first, leaf, parts in [*swaps, (self.leaves, self.leaves, [])]:
            chars += self.chars[self.size + at : self.size + first]
            tokens += self.tokens[self.size + at : self.size + first]
            cuts = [parts[k : k + LEAF] for k in range(0, len(parts), LEAF)]
            chars += [sum(map(len, part)) for part in cuts]
            tokens += [sum(encoder.counts(part)) for part in cuts]
            at = leaf
        self.__init__(chars, tokens)


def settled(edits: list[tuple[int | None, int | None, str | None]], size: int) -> list[Edit]:
    """Edits inside a text of ``size`` characters, in order, without those that overlap an earlier one."""
    out: list[Edit] = []
    clipped = [(max(0, min(a, size)), max(0, min(a, size), min(b, size)), x or "") for a, b, x in edits if a is not None and b is not None]
    for a, b, x in sorted(clipped, key=lambda e: e[:2]):
        if not out or a >= out[-1][1]:
            out.append((a, b, x))
    return out


def _applied(text: str, start: int, end: int, edits: list[Edit]) -> str:
    """text[start:end] after edits inside it."""
    out, at = [], start
    for a, b, x in edits:
        out += [text[at:a], x]
        at = b
    return "".join([*out, text[at:end]])


_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMBER = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{9,19})(?![0-9.])")


def redactions(text: str) -> list[Edit]:
    """Edits that put placeholders for mail addresses, network addresses and long numbers."""
    mails = [(m.start(), m.end(), "<EMAIL>") for m in _EMAIL.finditer(text)] if "@" in text else []
    ends = [e for _, e, _ in mails]

    def free(a: int, b: int) -> bool:
        k = bisect_left(ends, a + 1)
        return k == len(mails) or mails[k][0] >= b

    return sorted(mails + [(m.start(), m.end(), "<NUMBER>") for m in _NUMBER.finditer(text) if free(m.start(), m.end())])


_TREE = "leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"


def _source(docs: DataFrame, id_col: str, text_col: str, *more: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    return rows, rows.schema["doc_id"].dataType.simpleString()


def build_trees(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text, leaf_chars, leaf_tokens, n_tokens."""
    rows, id_type = _source(docs, id_col, text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(model)
        for batch in batches:
            trees = [CountTree.of(x.as_py(), encoder) for x in batch["text"]]
            arrays = [t.leaf_arrays() for t in trees]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array([c for c, _ in arrays], pa.list_(pa.int32())), pa.array([t for _, t in arrays], pa.list_(pa.int32())), pa.array([t.total for t in trees], pa.int64())], names=["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    return rows.mapInArrow(step, f"doc_id {id_type}, text string, {_TREE}")


def apply_edits(trees: DataFrame, *, edits_col: str = "edits", model: str | None = None) -> DataFrame:
    """Rows of ``build_trees`` with an ``array<struct<start,end,text>>`` column, after their edits: text, tree, counts, n_reencoded."""
    rows = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col(edits_col).alias("edits"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(model)
        for batch in batches:
            texts, chars, tokens, totals, encoded = [], [], [], [], []
            for row in batch.to_pylist():
                tree = CountTree(row["leaf_chars"], row["leaf_tokens"])
                edits = [(e["start"], e["end"], e["text"]) for e in row["edits"] or [] if e]
                text, n = tree.edit_all(row["text"], edits, encoder)
                c, t = tree.leaf_arrays()
                texts.append(text)
                chars.append(c)
                tokens.append(t)
                totals.append(tree.total)
                encoded.append(n)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array(totals, pa.int64()), pa.array(encoded, pa.int64())], names=["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_reencoded"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"doc_id {id_type}, text string, {_TREE}, n_reencoded long")


def recount(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = redactions, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Builds each tree, applies the edits that ``edits_of`` makes for the text, and reports both counts."""
    rows, id_type = _source(docs, id_col, text_col)
    names = ["n_tokens", "n_leaves", "n_edits", "n_reencoded", "n_tokens_after", "n_chars_after"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(model)
        for batch in batches:
            out = []
            for x in batch["text"]:
                text = x.as_py()
                tree = CountTree.of(text, encoder)
                before, leaves, edits = tree.total, tree.leaves, edits_of(text)
                text, encoded = tree.edit_all(text, edits, encoder)
                out.append((before, leaves, len(edits), encoded, tree.total, len(text)))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *names])

    return rows.mapInArrow(step, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names))
