"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Features are hashed word unigrams and bigrams (case kept) and n-grams of the punctuation between
words; a bigram of equal words, side by side or with one word between, is one feature whatever the word. Values
are dampened counts, scaled to unit length; a text's score is the sigmoid of a sparse dot product.

Scale: the model is fitted on at most ``max_rows`` labelled documents, those with the least hash of their id, and of these on
the first that have ``max_features`` features together (8 bytes each).
They are turned into features where they lie; one task runs the updates over these bounded
rows, in an order that doesn't depend on partitions. Scoring maps over all documents with the broadcast
weights (2^bits floats) and shuffles nothing.

Edge cases: null and empty texts have only the bias; null labels are left out; with no labelled
rows all scores are 0.5; repeated rows count as often as they appear; a null id isn't held out and has
no label. Labels and the other columns of the documents are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
MAX_ROWS = 20_000
MAX_FEATURES = 50_000_000
EPOCHS = 4
FOLDS = 5
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
_KEPT_WORDS = 1 << 20

_ASCII_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_TO_BLANK = bytes.maketrans(_ASCII_PUNCTUATION, b" " * len(_ASCII_PUNCTUATION))
_NOT_PUNCTUATION = bytes(b for b in range(256) if b not in _ASCII_PUNCTUATION and not 0x09 <= b <= 0x0D and b != 0x20)
_K = np.uint64(0x9E3779B97F4A7C15)
_SAME, _SAME_AGAIN = 0x5A17, 0x5A18


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = h = zlib.crc32(word) | zlib.adler32(word) << 32
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(raw: bytes | None, table: dict, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; index 0 is the bias."""
    parts = []
    if raw:
        for salt, words in ((1, raw.translate(_TO_BLANK).split()), (2, raw.translate(None, _NOT_PUNCTUATION).split())):
            if not words:
                continue
            h = np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words)) * np.uint64(2 * salt + 1)
            parts.append(_mix(h))
            pair = _mix(h[:-1] * _K + h[1:])
            pair[h[:-1] == h[1:]] = _SAME * salt
            parts.append(pair)
            again = int((h[:-2] == h[2:]).sum())
            if again:
                parts.append(np.full(again, _SAME_AGAIN * salt, dtype=np.uint64))
    if not parts:
        return np.zeros(1, dtype=np.int32), np.ones(1, dtype=np.float32)
    index, count = np.unique((np.concatenate(parts) & np.uint64((1 << bits) - 1)).astype(np.int32), return_counts=True)
    value = np.log1p(count)
    value *= 1 / np.sqrt((value * value).sum())
    return np.concatenate(([0], index)).astype(np.int32), np.concatenate(([0.5], value)).astype(np.float32)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of per-coordinate FTRL-proximal updates."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    weight = lambda i: np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    for _ in range(epochs):
        for index, value, label in rows:
            w = weight(index)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            # an index can repeat only as the bias; equal indices would keep the last update
            z[index] += g - sigma * w
            n[index] += g * g
    return weight(np.arange(1 << bits)).astype(np.float32)


def fold(id_col: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights fitted on at most ``max_rows`` labelled documents outside fold 0, and ``max_features`` features of theirs."""
    order = F.xxhash64(F.lit("fit"), "l_id")
    chosen = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where(f"l_id is not null and label is not null and pmod(crc32(string(l_id)), {FOLDS}) <> 0")
    chosen = chosen.orderBy(order, "l_id", "label").limit(max_rows)  # at most max_rows pairs of numbers
    text = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("binary").alias("text"))
    joined = text.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select(order.alias("at"), "l_id", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words()
        for batch in batches:
            found = [features(x.as_py(), table, bits) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["at"], batch["label"], pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], names=["at", "label", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            if held >= max_features:
                continue
            for y, i, v in zip(batch["label"].to_pylist(), batch["index"], batch["value"], strict=True):
                held += len(i)
                if held > max_features:
                    break
                # copies, so that a batch isn't kept for a few of its rows
                rows.append((np.array(i.values), np.array(v.values), y))
        yield pa.RecordBatch.from_pydict({"weights": [train_ftrl(rows, bits, epochs).tobytes()]})

    rows = joined.mapInArrow(extract, "at long, label int, index array<int>, value array<float>")
    got = rows.repartition(1).sortWithinPartitions("at", "label", F.xxhash64("index")).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(bytes(got[0].weights), np.float32) if got else np.zeros(1 << bits, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    shared, bits = docs.sparkSession.sparkContext.broadcast(weights), len(weights).bit_length() - 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, table = shared.value, _Words()
        for batch in batches:
            margin = []
            for raw in batch["text"]:
                index, value = features(raw.as_py(), table, bits)
                margin.append(float(w[index] @ value))
            scores = 1 / (1 + np.exp(-np.clip(np.array(margin, dtype=np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    return score(docs, fit(docs, labels, **params))
