"""Word rules shared by the operators of this subpackage, on UTF-8 bytes.

All bytes of a multi-byte character are at or above 0x80, so rules that only name ASCII
characters give the same words on bytes as on code points.
"""

from __future__ import annotations

#: A-Z to a-z, all else unchanged.
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def _fold() -> bytes:
    out = bytearray(LOWER)
    for b in (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)):
        out[b] = 0x20
    return bytes(out)


#: Lower case, and everything outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (after lower-casing) a blank.
FOLD = _fold()


def plain_words(raw: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``; null has none."""
    return raw.split() if raw else []


def lower_words(raw: bytes | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased."""
    return raw.translate(LOWER).split() if raw else []


def folded_words(raw: bytes | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased."""
    return raw.translate(FOLD).split() if raw else []
