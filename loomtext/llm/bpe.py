"""Byte-level BPE for workers: one encoder per process, with a bounded table of encoded pre-tokens.

The vocabulary comes from a tokenizers JSON file whose path is a parameter. Pre-tokens are encoded
apart from one another, so their ids are kept; the merging itself is done by tiktoken's BPE on the same
vocabulary, which gives the ids of the tokenizers library (the tests hold it against that).
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache, reduce

import regex
import tiktoken

DEFAULT_MODEL = "byte_bpe_50k.json"
KEPT_PRETOKENS = 1 << 20

# Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GENERAL = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
# The same with the letters, numbers and white space of Latin-1 written out, for texts without other characters.
_CLASSES = {r"[^\s\p{L}\p{N}]": "[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]", r"\p{L}": "[A-Za-zªµºÀ-ÖØ-öø-ÿ]", r"\p{N}": "[0-9²³¹¼½¾]", r"\s": "[\t-\r \x85\xa0]", r"\S": "[^\t-\r \x85\xa0]"}
_LATIN = re.compile(reduce(lambda pattern, c: pattern.replace(*c), _CLASSES.items(), PATTERN))
_BEYOND = re.compile("[^\x00-\xff]")
#: The pattern looks at most this many characters past a pre-token's end.
LOOK = 2


def pretokens(text: str) -> list[str]:
    return (_GENERAL if _BEYOND.search(text) else _LATIN).findall(text)


def _byte_of_char() -> dict[str, int]:
    """The published byte alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def resolve(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


@lru_cache(maxsize=2)
def _core(path: str) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = _byte_of_char()
    vocab = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
    # merging by rank equals merging by id only where later merges make higher ids
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError(f"{path}: merges are not in the order of their ids")
    return tiktoken.Encoding("byte-level", pat_str=r"[\s\S]+", mergeable_ranks=vocab, special_tokens={})


class _Table(dict):
    def __init__(self, encode, kept: int) -> None:
        super().__init__()
        self.encode, self.kept = encode, kept

    def __missing__(self, pretoken: str):
        if len(self) >= self.kept:
            self.clear()
        self[pretoken] = value = self.encode(pretoken)
        return value


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that the file adds beside the vocabulary's merges; in a text they are cut out before the pattern is applied."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that take white space or whole words aren't supported")
    return {t["content"]: t["id"] for t in added}


class Encoder:
    """``with_added``: whether the strings of added tokens become their ids, as in the tokenizers library, or are ordinary text."""

    def __init__(self, path: str | None = None, kept: int = KEPT_PRETOKENS, with_added: bool = True) -> None:
        path = resolve(path)
        piece = _core(path)._core_bpe.encode_single_piece
        added = added_tokens(path) if with_added else {}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        #: Characters on either side of a place that can bear on the pre-tokens there.
        self.context = max([LOOK, *map(len, added)])
        self.ids = lambda t: [added[t]] if t in added else piece(t.encode())
        self._bytes = _Table(lambda t: array("I", self.ids(t)).tobytes(), kept)
        self._counts = _Table(lambda t: len(self.ids(t)), kept)

    def pretokens(self, text: str) -> list[str]:
        if self._cut is None or not self._cut.search(text):
            return pretokens(text)
        parts = self._cut.split(text)  # every second part is an added token
        return [t for i, part in enumerate(parts) for t in ([part] if i % 2 else pretokens(part))]

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self._bytes.__getitem__, self.pretokens(text)))

    def counts(self, parts: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        return list(map(self._counts.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str | None = None, with_added: bool = True) -> Encoder:
    """This process's encoder."""
    return Encoder(path, with_added=with_added)
