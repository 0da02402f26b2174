"""Model tokenizers as Column functions: encode, decode, pairs, special tokens, padding, and their single steps.

A ``Tokenizer`` is a JSON description (BPE, WordPiece, Unigram or WordLevel, with normalizer, pre-tokenizer, post-processor,
decoder and added tokens), a rank file with a split pattern, or a SentencePiece model. It travels to the workers once with the
function and is built once in each. Encodings are structs of arrays: ids, tokens, starts and ends (code points of the
text as given), type_ids, special, attention.

A null text gives null. Truncation follows the special tokens for single texts and comes before them for pairs.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import tiktoken
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.batches import text_udf
from loomtext.functions.tokens import pad, truncate

ENCODING = "struct<ids:array<int>,tokens:array<string>,starts:array<int>,ends:array<int>,type_ids:array<int>,special:array<int>,attention:array<int>>"
MODELS = ("BPE", "WordPiece", "Unigram", "WordLevel")


@lru_cache(maxsize=8)
def _built(description: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_str(description)


def load_json(text: str) -> dict:
    """A tokenizer description, with the older shapes made current; raises ValueError for what isn't one."""
    try:
        config = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"not a tokenizer description: {e}") from e
    model = config.get("model") if isinstance(config, dict) else None
    if not isinstance(model, dict) or "vocab" not in model:
        raise ValueError("a tokenizer description has a model with a vocabulary")
    if "type" not in model:
        model["type"] = "BPE" if "merges" in model else "Unigram" if isinstance(model["vocab"], list) else "WordPiece" if "continuing_subword_prefix" in model else "WordLevel"
    if model["type"] not in MODELS:
        raise ValueError(f"unknown model {model['type']}")
    if model.get("merges") and isinstance(model["merges"][0], str):
        model["merges"] = [m.split(" ", 1) for m in model["merges"]]
    for part in ("truncation", "padding", "normalizer", "pre_tokenizer", "post_processor", "decoder"):
        config.setdefault(part, None)
    config.setdefault("version", "1.0")
    config.setdefault("added_tokens", [])
    return config


def _row(e: tokenizers.Encoding) -> dict:
    return {"ids": e.ids, "tokens": e.tokens, "starts": [a for a, _ in e.offsets], "ends": [b for _, b in e.offsets], "type_ids": e.type_ids, "special": e.special_tokens_mask, "attention": e.attention_mask}


@dataclass(frozen=True)
class Tokenizer:
    description: str

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        """Read on the driver."""
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        description = json.dumps(load_json(text), ensure_ascii=False)
        try:
            _built(description)
        except Exception as e:
            raise ValueError(f"not a tokenizer that can be run: {e}") from e
        return cls(description)

    def encode(self, c: Column, *, add_special: bool = True, most: int | None = None, side: str = "right") -> Column:
        """Encodings; ``most`` cuts them after the special tokens are in."""
        description = self.description

        def apply(texts: pd.Series) -> pd.DataFrame:
            known = [x for x in texts if x is not None]
            found = iter(_built(description).encode_batch(known, add_special_tokens=add_special))
            return _frame([None if x is None else _row(next(found)) for x in texts])

        out = F.pandas_udf(apply, ENCODING)(c)
        if most is None:
            return F.when(c.isNotNull(), out)
        fields = ("ids", "tokens", "starts", "ends", "type_ids", "special", "attention")
        return F.when(c.isNotNull(), F.transform(F.array(out), lambda e: F.struct(*[truncate(e[f], most, side).alias(f) for f in fields]))[0])

    def ids(self, c: Column, *, add_special: bool = True) -> Column:
        description = self.description

        def apply(texts: pd.Series) -> pd.Series:
            known = iter(_built(description).encode_batch([x for x in texts if x is not None], add_special_tokens=add_special))
            return pd.Series([None if x is None else next(known).ids for x in texts], dtype=object)

        return F.pandas_udf(apply, "array<int>")(c)

    def encode_pair(self, a: Column, b: Column, *, add_special: bool = True, most: int | None = None, strategy: str = "longest_first") -> Column:
        """Encodings of two texts; ``most`` cuts both together before the special tokens come in, so these may pass it."""
        description = self.description

        def apply(left: pd.Series, right: pd.Series) -> pd.DataFrame:
            own = tokenizers.Tokenizer.from_str(description) if most is not None else _built(description)
            rows = []
            for x, y in zip(left, right, strict=True):
                if x is None or y is None:
                    rows.append(None)
                elif most is None:
                    rows.append(_row(own.encode(x, y, add_special_tokens=add_special)))
                else:
                    extra = own.num_special_tokens_to_add(True) if add_special else 0
                    own.enable_truncation(most + extra, strategy=strategy)
                    rows.append(_row(own.encode(x, y, add_special_tokens=add_special)))
            return _frame(rows)

        return F.when(a.isNotNull() & b.isNotNull(), F.pandas_udf(apply, ENCODING)(a, b))

    def count(self, c: Column, *, add_special: bool = True) -> Column:
        return F.size(self.ids(c, add_special=add_special))

    def decode(self, ids: Column, *, skip_special: bool = True) -> Column:
        """Null for ids that aren't in the vocabulary."""
        description = self.description

        def one(row) -> str | None:
            own = _built(description)
            row = [int(i) for i in row]
            return own.decode(row, skip_special_tokens=skip_special) if all(own.id_to_token(i) is not None for i in row) else None

        return text_udf(one, "string")(ids)

    def normalize(self, c: Column) -> Column:
        description = self.description
        return text_udf(lambda x: n.normalize_str(x) if (n := _built(description).normalizer) else x, "string")(c)

    def pre_tokenize(self, c: Column) -> Column:
        """array<struct<text, start, end>> after normalization."""
        description = self.description

        def one(x: str) -> list[dict]:
            own = _built(description)
            x = own.normalizer.normalize_str(x) if own.normalizer else x
            parts = own.pre_tokenizer.pre_tokenize_str(x) if own.pre_tokenizer else [(x, (0, len(x)))]
            return [{"text": t, "start": a, "end": b} for t, (a, b) in parts]

        return text_udf(one, "array<struct<text:string,start:int,end:int>>")(c)

    def join_tokens(self, tokens: Column) -> Column:
        """The decoder chain alone."""
        description = self.description
        return text_udf(lambda t: d.decode(list(t)) if (d := _built(description).decoder) else " ".join(t), "string")(tokens)

    def vocabulary(self, spark) -> DataFrame:
        """(token, id), added tokens included."""
        return spark.createDataFrame(sorted(_built(self.description).get_vocab().items(), key=lambda x: x[1]), "token string, id int")


_EMPTY = {"ids": [], "tokens": [], "starts": [], "ends": [], "type_ids": [], "special": [], "attention": []}


def _frame(rows: list[dict | None]) -> pd.DataFrame:
    return pd.DataFrame([r or _EMPTY for r in rows], columns=list(_EMPTY))


def with_parts(model: dict | None = None, **parts: dict | None) -> Tokenizer:
    """A tokenizer of single steps, such as ``with_parts(normalizer={"type": "NFC"})``; without a model every word is unknown."""
    model = model or {"type": "WordLevel", "vocab": {"[UNK]": 0}, "unk_token": "[UNK]"}
    return Tokenizer.from_json(json.dumps({"model": model, **parts}))


def word_level(vocabulary: dict[str, int], unknown: str = "[UNK]") -> Tokenizer:
    return with_parts({"type": "WordLevel", "vocab": vocabulary, "unk_token": unknown}, pre_tokenizer={"type": "WhitespaceSplit"})


def word_piece(vocabulary: dict[str, int], unknown: str = "[UNK]", prefix: str = "##", longest: int = 100) -> Tokenizer:
    model = {"type": "WordPiece", "vocab": vocabulary, "unk_token": unknown, "continuing_subword_prefix": prefix, "max_input_chars_per_word": longest}
    return with_parts(model, pre_tokenizer={"type": "WhitespaceSplit"}, decoder={"type": "WordPiece", "prefix": prefix, "cleanup": False})


def unigram(pieces: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = False) -> Tokenizer:
    """The best segmentation by the sum of the pieces' log probabilities."""
    return with_parts({"type": "Unigram", "unk_id": unknown, "vocab": [list(p) for p in pieces], "byte_fallback": byte_fallback})


def bpe(vocabulary: dict[str, int], merges: list[tuple[str, str]], unknown: str | None = None, byte_fallback: bool = False) -> Tokenizer:
    return with_parts({"type": "BPE", "vocab": vocabulary, "merges": [list(m) for m in merges], "unk_token": unknown, "byte_fallback": byte_fallback})


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(maxsize=4)
def _ranked(name: str, pattern: str, ranks: tuple, specials: tuple) -> tiktoken.Encoding:
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens=dict(specials))


@dataclass(frozen=True)
class RankTokenizer:
    """Byte-level BPE by ranks, with a policy for the strings of special tokens in a text."""

    ranks: dict[bytes, int] = field(repr=False, hash=False)
    pattern: str
    specials: dict[str, int] = field(default_factory=dict, hash=False)

    def _encoding(self) -> tiktoken.Encoding:
        return _ranked("ranks", self.pattern, tuple(self.ranks.items()), tuple(self.specials.items()))

    def encode(self, c: Column, *, allowed: set[str] | str = frozenset(), disallowed: set[str] | str = "all") -> Column:
        """Ids; allowed special strings become their ids, disallowed ones make the result null, others are ordinary text. ``all`` names all."""

        def one(text: str) -> list[int] | None:
            try:
                return self._encoding().encode(text, allowed_special="all" if allowed == "all" else set(allowed), disallowed_special="all" if disallowed == "all" else tuple(disallowed))
            except ValueError:
                return None

        return text_udf(one, "array<int>")(c)

    def decode(self, ids: Column) -> Column:
        """Bytes that aren't UTF-8 become replacement characters; unknown ids give null."""

        def one(row) -> str | None:
            try:
                return self._encoding().decode([int(i) for i in row])
            except KeyError:
                return None

        return text_udf(one, "string")(ids)


def _byte_alphabet() -> dict[int, str]:
    """The published byte alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


BYTE_ALPHABET = _byte_alphabet()


def byte_level_encode(c: Column) -> Column:
    """One character of the byte alphabet for each UTF-8 byte."""
    return text_udf(lambda x: "".join(map(BYTE_ALPHABET.__getitem__, x.encode())), "string")(c)


def byte_level_decode(c: Column) -> Column:
    """The inverse; characters outside the alphabet stand for their own UTF-8 bytes, and what isn't UTF-8 is replaced."""
    back = {ch: bytes([b]) for b, ch in BYTE_ALPHABET.items()}
    return text_udf(lambda x: b"".join(back.get(ch) or ch.encode() for ch in x).decode(errors="replace"), "string")(c)


def pad_batch(df: DataFrame, ids_col: str, *, token: int = 0, fixed: int | None = None, side: str = "right", group_col: str | None = None) -> DataFrame:
    """``df`` with all arrays of a group (or of the whole table) filled to the longest, or to ``fixed``, and an attention column."""
    if fixed is None:
        grouped = df.groupBy(group_col) if group_col else df
        longest = grouped.agg(F.max(F.size(ids_col)).alias("_longest"))
        # one row, or one per group, which adaptive execution broadcasts while it is small
        df = df.join(longest, group_col) if group_col else df.join(F.broadcast(longest), F.lit(True))
        to = F.col("_longest")
    else:
        to = F.lit(fixed)
    ones = F.transform(F.col(ids_col), lambda _: F.lit(1))
    return df.withColumn("attention", pad(ones, to, 0, side)).withColumn(ids_col, pad(F.col(ids_col), to, token, side)).drop("_longest")


def sentencepiece_ids(c: Column, model: bytes) -> Column:
    """Ids of a SentencePiece model, given as the bytes of its file."""
    return text_udf(lambda x: _piece_model(model).encode(x, num_threads=1), "array<int>")(c)


def sentencepiece_decode(ids: Column, model: bytes) -> Column:
    return text_udf(lambda row: _piece_model(model).decode([int(i) for i in row]), "string")(ids)


@lru_cache(maxsize=2)
def _piece_model(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)
