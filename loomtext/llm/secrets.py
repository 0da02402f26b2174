"""Secret scanning: patterns for known forms, and a token-efficiency test for the rest.

Base kinds are assignments to secret-like names, access keys and long hexadecimal runs. The
method adds ``dense`` spans: runs of key characters that cost a tiktoken vocabulary many
tokens for their length, as random strings do, unless they are a known digest's form (hexadecimal of
a digest's length), a UUID, or an identifier made of words and numbers. Tested are the parts of a run that lie
outside the base spans: those with letters and digits as a whole, others by their stretches of letters, but for
those all in capitals; small letters alone are held to a lower ratio, which long compounds don't reach.

Scale: rows are mapped, nothing is shuffled; a row's work is linear in its text: the patterns don't backtrack
over what they took, and runs and spans are walked side by side.

Edge cases: null is the empty text and has no spans; repeated rows are answered each; positions are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import bpe

KINDS = ("assign", "access", "hex", "dense")
MIN_VALUE, MIN_HEX, MIN_DENSE = 12, 16, 16
MAX_CHARS_PER_TOKEN = 2.2
SMALL_LETTERS = 0.9  # of that ratio
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "api")
# A greedy match that is too short is dropped with all it took, and holds no longer one: the bounds can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ANY_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: Words of three letters or more, or numbers, joined by separators or by case. Each word is atomic, so a match never tries another cut.
_IDENTIFIER = re.compile(r"(?:(?>[A-Z]?[a-z]{3,}|[A-Z]{3,}(?![a-z])|[0-9]+)[_/+=-]*+)++")
_LETTERS = re.compile(rf"[A-Za-z]{{{MIN_DENSE},}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return found


def _is_known(value: str) -> bool:
    value = value.strip("=-_/+")
    return bool((_ANY_HEX.fullmatch(value) and len(value) in DIGEST_LENGTHS) or _UUID.fullmatch(value) or _IDENTIFIER.fullmatch(value))


@lru_cache(maxsize=2)
def _counter(vocabulary: str | None):
    import base64

    import tiktoken

    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("spans", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _parts(a: int, b: int, spans: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """[a, b) without the sorted spans from number ``at`` on, and the first span that a later run can meet."""
    out = []
    while at < len(spans) and spans[at][1] <= a:
        at += 1
    i = at
    while i < len(spans) and spans[i][0] < b:
        if spans[i][0] > a:
            out.append((a, spans[i][0]))
        a = max(a, spans[i][1])
        i += 1
    if a < b:
        out.append((a, b))
    return out, at


def _candidates(text: str, a: int, b: int) -> Iterator[tuple[int, int, float]]:
    """(start, end, share of the ratio) of what is to be tested in [a, b)."""
    value = text[a:b]
    if any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
        yield a, b, 1.0
    else:
        for m in _LETTERS.finditer(value):
            if not m[0].isupper():
                yield a + m.start(), a + m.end(), SMALL_LETTERS if m[0][1:].islower() else 1.0


def spans_of(text: str, max_chars_per_token: float = MAX_CHARS_PER_TOKEN, vocabulary: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, sorted."""
    found = base_spans(text)
    runs = [m.span() for m in _RUN.finditer(text)]
    for a, b in runs:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b)]
    base, at, dense = _merged(found), 0, []
    for a, b in runs:
        parts, at = _parts(a, b, base, at)
        for x, y in parts:
            if y - x >= MIN_DENSE:
                for s, e, share in _candidates(text, x, y):
                    one_case = share < 1  # a word of one case would pass for an identifier whatever its letters
                    if (one_case or not _is_known(text[s:e])) and (e - s) < share * max_chars_per_token * _counter(vocabulary)(text[s:e]):
                        dense.append((s, 3, e))
    return sorted(found + dense)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans of any kind cover, ascending."""
    out: list[list[int]] = []
    for s, _, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_report(docs: DataFrame, *, max_chars_per_token: float = MAX_CHARS_PER_TOKEN, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_dense, base_sha256, spans (kind:start:end, comma-joined)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], [], []), [], []
            for text in batch["text"]:
                found = spans_of(text.as_py(), max_chars_per_token, vocabulary)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(_joined([x for x in found if x[1] < 3]).encode()).hexdigest())
                spans.append(_joined(found))
            arrays = [batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_dense", "base_sha256", "spans"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_dense long, base_sha256 string, spans string")
