"""Escapes and their inverses for HTML, JSON, URIs, shells, C strings and regular expressions.

``escape`` and ``unescape`` choose by target. What can't be undone (a broken escape, bytes that aren't UTF-8) gives null.
"""

from __future__ import annotations

import html
import re
import shlex

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import strings
from loomtext.functions.batches import text_udf


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def html_text(c: Column) -> Column:
    """For text bodies: & < > and both quotes, and the slash."""
    return _replaced(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")))


def html_attribute(c: Column) -> Column:
    """For attribute values in double quotes: & < > and the double quote."""
    return _replaced(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


#: One numeric or named reference that ends in a semicolon; others stay as they are.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _unescaped(text: str) -> str:
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def unescape_html(c: Column) -> Column:
    """Numeric references and all named ones of HTML 5; unknown names stay."""
    return F.when(F.contains(c, F.lit("&")), text_udf(_unescaped, "string")(c)).otherwise(c)


def unescape_json(c: Column) -> Column:
    """The text whose JSON string has this body; null where the body isn't valid."""
    # a pattern for the whole body would recurse once for each character
    broken = F.regexp_replace(c, r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})', "").rlike(r'["\\\x00-\x1F]')
    return F.when(~broken, F.get_json_object(F.concat(F.lit('{"v":"'), c, F.lit('"}')), "$.v"))


#: Characters that stay beside letters and digits.
PERCENT_SETS = {"none": "", "unreserved": "-._~", "path": "-._~!$&'()*+,;=:@/", "query": "-._~!$&'()*+,;=:@/?"}


def percent_encode(c: Column, allowed: str = "unreserved") -> Column:
    """Percent escapes of the UTF-8 bytes of all but letters, digits and an ``allowed`` set."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    stays = PERCENT_SETS[allowed]
    for ch in "*-._":
        if ch not in stays:
            out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    for ch in stays:
        if ch not in "*-._":
            out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def uri_component(c: Column) -> Column:
    """Everything but letters and digits."""
    return percent_encode(c, "none")


def _words(text: str) -> list[str] | None:
    try:
        return shlex.split(text)
    except ValueError:
        return None


def shell_unquote(c: Column) -> Column:
    """The one word that a POSIX shell would read, null for none, several or an open quote."""
    return text_udf(lambda x: w[0] if (w := _words(x)) is not None and len(w) == 1 else None, "string")(c)


def _windows(text: str) -> str:
    # backslashes count double before a quote, the closing one included
    return '"' + re.sub(r'(\\*)("|\Z)', lambda m: m[1] * 2 + ('\\"' if m[2] else ""), text) + '"' if text else '""'


def shell_windows(c: Column) -> Column:
    """One argument for programs that split their command line by the documented rules of quotes and backslashes."""
    return F.when(c.rlike(r"\A[A-Za-z0-9_.\-]+\z"), c).otherwise(text_udf(_windows, "string")(c))


# The simple escapes of C string literals.
_C_SIMPLE = {"\\": "\\", "'": "'", '"': '"', "?": "?", "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_C_WRITTEN = {0x5C: "\\\\", 0x22: '\\"', 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"}
_C_ESCAPE = re.compile(r"""\\(?:([\\'"?abfnrtv])|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([0-7]{1,3})|(.?))""", re.DOTALL)


def _c_escaped(text: str) -> str:
    return "".join(_C_WRITTEN.get(b) or (chr(b) if 0x20 <= b <= 0x7E else f"\\x{b:02x}") for b in text.encode())


def _c_unescaped(text: str) -> str | None:
    def one(m: re.Match) -> bytes:
        simple, byte, short, wide, octal, _ = m.groups()
        if simple:
            return _C_SIMPLE[simple].encode()
        if byte or octal:
            return bytes([int(byte, 16) if byte else int(octal, 8)])
        if short or wide:
            return chr(int(short or wide, 16)).encode()
        raise ValueError(m[0])

    out, at = [], 0
    try:
        for m in _C_ESCAPE.finditer(text):
            out += [text[at : m.start()].encode(), one(m)]
            at = m.end()
        return b"".join([*out, text[at:].encode()]).decode()
    except (ValueError, OverflowError):
        return None


def c_string(c: Column) -> Column:
    """The body of a C string literal; other bytes outside printable ASCII as two hexadecimal digits."""
    return F.when(c.rlike(r'[^\x20-\x7E]|["\\]'), text_udf(_c_escaped, "string")(c)).otherwise(c)


def unescape_c_string(c: Column) -> Column:
    """Simple, hexadecimal, octal and Unicode escapes."""
    return F.when(F.contains(c, F.lit("\\")), text_udf(_c_unescaped, "string")(c)).otherwise(c)


ESCAPES = {"uri": uri_component, "html": html_text, "json": strings.escape_json, "shell": strings.shell_quote}
UNESCAPES = {"uri": strings.percent_decode, "html": unescape_html, "json": unescape_json, "shell": shell_unquote}


def escape(c: Column, target: str) -> Column:
    """For ``uri``, ``html``, ``json`` or ``shell``."""
    return ESCAPES[target](c)


def unescape(c: Column, target: str) -> Column:
    return UNESCAPES[target](c)
