"""String functions as Column expressions: search, trim, pad, slice, split, replace, case, escape, clean.

All positions and lengths are code points unless a name says bytes; a null argument gives null.
"""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.batches import text_udf

#: Blank, tab, line feed, form feed and carriage return: the white space of RE2.
ASCII_WHITE = r"[ \t\n\f\r]"
WHITE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
REGEX_META = r"([\\.+*?()|\[\]{}^$#&\-~])"


def find(c: Column, needle: str) -> Column:
    """0-based offset of the first match, null if there is none; the empty needle is at 0."""
    at = F.instr(c, needle) - 1 if needle else F.when(c.isNotNull(), F.lit(0))
    return F.when(at >= 0, at)


def rfind(c: Column, needle: str) -> Column:
    at = F.instr(F.reverse(c), needle[::-1])
    return F.when(at > 0, F.length(c) - at + 1 - len(needle))


def count_matches(c: Column, needle: str) -> Column:
    """Non-overlapping matches; the empty needle matches before every code point and at the end."""
    if not needle:
        return F.length(c) + 1
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def find_all(c: Column, needle: str) -> Column:
    """Offsets of non-overlapping matches; the empty needle is at every code point and at the end."""
    if not needle:
        return F.sequence(F.lit(0), F.length(c))

    def places(text: str) -> list[int]:
        out, at = [], text.find(needle)
        while at >= 0:
            out.append(at)
            at = text.find(needle, at + len(needle))
        return out

    return text_udf(places, "array<int>")(c)


find_iter = find_all


def byte_offset(c: Column, at: Column) -> Column:
    """The UTF-8 offset of a code-point offset; null stays null."""
    return F.octet_length(F.substring(c, F.lit(1), at))


def find_any(c: Column, needles: list[str]) -> Column:
    """struct<at, needle> of the leftmost match of any needle, the first listed on ties; null without one."""
    hits = [F.when(find(c, n).isNotNull(), F.struct(find(c, n).alias("at"), F.lit(i).alias("needle"))) for i, n in enumerate(needles)]
    return F.array_min(F.array_compact(F.array(*hits)))


def find_overlapping(c: Column, needle: str) -> Column:
    n = F.length(c) - len(needle) + 1
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i + 1, F.lit(len(needle))) == needle)).otherwise(F.array().cast("array<int>"))


def _quoted(needle: str) -> str:
    return r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"


def wildcard(c: Column, pattern: str, anchored: bool = True) -> Column:
    """``*`` any run, ``?`` one code point, all else literal."""
    body = "".join(".*" if p == "*" else "." if p == "?" else _quoted(p) for p in pattern)
    return c.rlike(rf"(?s)\A{body}\z" if anchored else f"(?s){body}")


def trim(c: Column, white: str = WHITE) -> Column:
    return trim_end(trim_start(c, white), white)


def trim_start(c: Column, white: str = WHITE) -> Column:
    return F.regexp_replace(c, f"^{white}+", "")


def trim_end(c: Column, white: str = WHITE) -> Column:
    return F.regexp_replace(c, rf"{white}+\z", "")


def trim_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def trim_start_chars(c: Column, chars: str) -> Column:
    return F.ltrim(c, F.lit(chars))


def trim_end_chars(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def trim_matches(c: Column, character_class: str, side: str = "both") -> Column:
    """Without the characters of a class such as ``\\p{P}`` at the ends."""
    start, end = f"^[{character_class}]+", rf"[{character_class}]+\z"
    out = c if side == "end" else F.regexp_replace(c, start, "")
    return out if side == "start" else F.regexp_replace(out, end, "")


def trim_start_matches(c: Column, character_class: str) -> Column:
    return trim_matches(c, character_class, "start")


def trim_end_matches(c: Column, character_class: str) -> Column:
    return trim_matches(c, character_class, "end")


class Trim:
    """A trim put together: ``Trim().chars("xy").start_only().apply(c)``; white space unless told otherwise, both ends."""

    def __init__(self, of: str = WHITE[1:-1], side: str = "both") -> None:
        self._class, self._side = of, side

    def chars(self, chars: str) -> Trim:
        return Trim("".join("\\" + x if x in "\\^-[]&" else x for x in chars), self._side)

    def matching(self, character_class: str) -> Trim:
        return Trim(character_class, self._side)

    def start_only(self) -> Trim:
        return Trim(self._class, "start")

    def end_only(self) -> Trim:
        return Trim(self._class, "end")

    def apply(self, c: Column) -> Column:
        return trim_matches(c, self._class, self._side)


def _fill_bytes(c: Column, width: int, fill: str) -> Column:
    """How many fills fit up to ``width`` bytes."""
    return F.greatest(F.floor((F.lit(width) - F.octet_length(c)) / len(fill.encode())).cast("int"), F.lit(0))


def pad_left_bytes(c: Column, width: int, fill: str = " ") -> Column:
    """Filled up to ``width`` bytes at most; a fill that would pass it is left out."""
    return F.concat(F.repeat(F.lit(fill), _fill_bytes(c, width, fill)), c)


def pad_right_bytes(c: Column, width: int, fill: str = " ") -> Column:
    return F.concat(c, F.repeat(F.lit(fill), _fill_bytes(c, width, fill)))


def center_bytes(c: Column, width: int, fill: str = " ") -> Column:
    """An odd extra fill goes right."""
    n = _fill_bytes(c, width, fill)
    left = F.floor(n / 2).cast("int")
    return F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), n - left))


def _is_boundary(raw: Column, at: int) -> Column:
    """Whether a byte offset lies between characters: the byte there isn't a continuation (10xxxxxx)."""
    here = F.hex(F.substring(raw, at + 1, 1))
    return (F.octet_length(raw) == at) | (here < "80") | (here >= "C0")


def slice_bytes(c: Column, start: int, end: int) -> Column:
    """Null where a bound isn't between characters, or lies past the end."""
    raw = F.encode(c, "UTF-8")
    fits = (F.octet_length(raw) >= end) & _is_boundary(raw, start) & _is_boundary(raw, end)
    return F.when(fits & F.lit(start <= end), F.decode(F.substring(raw, start + 1, max(0, end - start)), "UTF-8"))


def _snapped(raw: Column, n: int) -> Column:
    """The last character boundary at or before byte ``n``."""
    steps = [F.when((F.octet_length(raw) >= n - k) & _is_boundary(raw, n - k), n - k) for k in range(min(4, n + 1))]
    return F.when(F.octet_length(raw) <= n, F.octet_length(raw)).otherwise(F.coalesce(*steps))


def take_bytes(c: Column, n: int) -> Column:
    """At most ``n`` bytes of whole characters."""
    raw = F.encode(c, "UTF-8")
    return F.decode(F.substring(raw, F.lit(1), _snapped(raw, n)), "UTF-8")


def drop_bytes(c: Column, n: int) -> Column:
    """What ``take_bytes`` leaves."""
    raw = F.encode(c, "UTF-8")
    return F.decode(F.substring(raw, _snapped(raw, n) + 1, F.octet_length(raw)), "UTF-8")


def pad_left(c: Column, width: int, fill: str = " ") -> Column:
    """Never truncates."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def pad_right(c: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, fill))


def center(c: Column, width: int, fill: str = " ") -> Column:
    """An odd extra fill goes right."""
    gap = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    left = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), gap - left))


def take_scalars(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def drop_scalars(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(n + 1), F.length(c))


def slice_scalars(c: Column, start: int, end: int) -> Column:
    return F.substring(c, start + 1, max(0, end - start))


def graphemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\X)"), F.lit(1))


def slice_graphemes(c: Column, start: int, end: int) -> Column:
    return F.array_join(F.slice(graphemes(c), F.lit(start + 1), F.lit(max(0, end - start))), "")


def take_graphemes(c: Column, n: int) -> Column:
    return slice_graphemes(c, 0, n)


def drop_graphemes(c: Column, n: int) -> Column:
    return F.transform(F.array(graphemes(c)), lambda g: F.array_join(F.slice(g, F.lit(n + 1), F.size(g)), ""))[0]


def first_char(c: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(F.substring(c, 1, 1), F.lit(""))


def last_char(c: Column) -> Column:
    return F.nullif(F.right(c, F.lit(1)), F.lit(""))


def first_grapheme(c: Column) -> Column:
    return F.get(graphemes(c), F.lit(0))


def last_grapheme(c: Column) -> Column:
    return F.transform(F.array(graphemes(c)), lambda g: F.get(g, F.size(g) - 1))[0]


split_graphemes = graphemes


def byte_len(c: Column) -> Column:
    return F.octet_length(c)


def scalar_count(c: Column) -> Column:
    return F.length(c)


def grapheme_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\X"))


def split(c: Column, sep: str) -> Column:
    return F.split(c, _quoted(sep))


def splitn(c: Column, sep: str, n: int) -> Column:
    return F.split(c, _quoted(sep), n)


def split_whitespace(c: Column) -> Column:
    return F.filter(F.split(c, f"{WHITE}+"), lambda x: x != "")


def split_once(c: Column, sep: str) -> Column:
    """(head, tail) at the first separator, null without one."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.struct(F.substring(c, F.lit(1), at - 1).alias("head"), F.substring(c, at + len(sep), F.length(c)).alias("tail")))


def split_matches(c: Column, character_class: str) -> Column:
    """Cut at every character of a class; empty parts stay."""
    return F.split(c, f"[{character_class}]")


def split_terminator(c: Column, sep: str) -> Column:
    """As ``split``, without an empty last part."""
    return F.transform(F.array(split(c, sep)), lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))[0]


def rsplit(c: Column, sep: str) -> Column:
    """The parts from the right."""
    return F.reverse(split(c, sep))


def rsplit_once(c: Column, sep: str) -> Column:
    """(head, tail) at the last separator, null without one."""
    at = rfind(c, sep)
    return F.when(at.isNotNull(), F.struct(F.substring(c, F.lit(1), at).alias("head"), F.substring(c, at + 1 + len(sep), F.length(c)).alias("tail")))


def join(items: Column, sep: str) -> Column:
    """Null items are left out."""
    return F.array_join(items, sep)


intercalate = join


def join_into(prefix: Column, items: Column, sep: str) -> Column:
    """Joined behind a text that is there already."""
    return F.concat(prefix, F.array_join(items, sep))


def join_with(items: Column, sep: str, shape) -> Column:
    return F.array_join(F.transform(items, shape), sep)


def concat(items: Column) -> Column:
    return F.array_join(items, "")


def split_lines(c: Column) -> Column:
    """Lines without LF or CRLF; a closing line feed opens no line."""
    lines = F.split(c, "\r?\n")
    return F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def replace_first(c: Column, old: str, new: str) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def replace_last(c: Column, old: str, new: str) -> Column:
    return F.reverse(replace_first(F.reverse(c), old[::-1], new[::-1]))


def replace_n(c: Column, old: str, new: str, n: int) -> Column:
    """The first ``n`` matches."""
    return F.array_join(F.split(c, _quoted(old), n + 1), new) if n > 0 else c


def remove(c: Column, needle: str) -> Column:
    return F.replace(c, F.lit(needle), F.lit(""))


def replace_matches(c: Column, character_class: str, new: str) -> Column:
    """Every character of a class."""
    return F.regexp_replace(c, f"[{character_class}]", new.replace("\\", "\\\\").replace("$", "\\$"))


def replace_with(c: Column, old: str, new) -> Column:
    """Every match by ``new`` of its number, a Column function of a Column."""
    parts = F.split(c, _quoted(old))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(new(i - 1), p))), "")


def replace_bounded(c: Column, old: str, new: str, most: int) -> Column:
    """Null where the result would have more than ``most`` bytes."""
    out = replace_all(c, old, new)
    return F.when(F.octet_length(out) <= most, out)


def replace_many(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """One pass: at each place the first listed pair that matches; what was put in isn't looked at again. Empty needles are ignored."""
    pairs = list({old: new for old, new in reversed(pairs) if old}.items())[::-1]
    if not pairs:
        return c
    pattern = "|".join(_quoted(old) for old, _ in pairs)
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    between, hits = F.split(c, pattern), F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), hits.alias("b")), lambda z: F.array(z["a"], table[z["b"]]))), "")


def translate(c: Column, source: str, target: str) -> Column:
    return F.translate(c, source, target)


def to_lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def to_upper_ascii(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def to_lowercase(c: Column) -> Column:
    return F.lower(c)


def to_uppercase(c: Column) -> Column:
    return F.upper(c)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), drop_scalars(c, 1))


def title_case(c: Column) -> Column:
    """A new word starts after anything that isn't a letter."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def words_of_identifier(c: Column) -> Column:
    """Words of a snake, kebab, dotted or camel case identifier."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def to_case(c: Column, style: str) -> Column:
    words = F.transform(words_of_identifier(c), F.lower)
    upper_first = lambda w: capitalize(w)
    return {
        "snake": lambda: F.array_join(words, "_"),
        "screaming_snake": lambda: F.upper(F.array_join(words, "_")),
        "kebab": lambda: F.array_join(words, "-"),
        "dotted": lambda: F.array_join(words, "."),
        "pascal": lambda: F.array_join(F.transform(words, upper_first), ""),
        "camel": lambda: F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(capitalize(w))), ""),
        "screaming_kebab": lambda: F.upper(F.array_join(words, "-")),
        "train": lambda: F.array_join(F.transform(words, upper_first), "-"),
        "title": lambda: F.array_join(F.transform(words, upper_first), " "),
    }[style]()


def detect_case(c: Column) -> Column:
    """snake, screaming_snake, kebab, screaming_kebab, train, camel or pascal; null for other texts, mixed ones and single words of one case."""
    return (
        F.when(F.contains(c, F.lit("_")) & F.contains(c, F.lit("-")), F.lit(None).cast("string"))
        .when(c.rlike(r"\A[a-z0-9]+(_[a-z0-9]+)+\z"), "snake")
        .when(c.rlike(r"\A[A-Z0-9]+(_[A-Z0-9]+)+\z"), "screaming_snake")
        .when(c.rlike(r"\A[a-z0-9]+(-[a-z0-9]+)+\z"), "kebab")
        .when(c.rlike(r"\A[A-Z0-9]+(-[A-Z0-9]+)+\z"), "screaming_kebab")
        .when(c.rlike(r"\A[A-Z][a-z0-9]*(-[A-Z][a-z0-9]*)+\z"), "train")
        .when(c.rlike(r"\A(?=.*[A-Z])[a-z][A-Za-z0-9]*\z"), "camel")
        .when(c.rlike(r"\A(?=.*[a-z])[A-Z][A-Za-z0-9]*\z"), "pascal")
    )


def sanitize(c: Column, replacement: str = "_", *, allowed: str = "A-Za-z0-9_", fix_leading_digit: bool = True, max_len: int | None = None) -> Column:
    """Every character outside ``allowed`` replaced, none joined; a leading digit gets the replacement before it; at most ``max_len`` bytes."""
    out = F.regexp_replace(c, f"[^{allowed}]", replacement)
    if fix_leading_digit:
        out = F.when(out.rlike("^[0-9]"), F.concat(F.lit(replacement), out)).otherwise(out)
    return take_bytes(out, max_len) if max_len is not None else out


def slugify(c: Column, separator: str = "-", max_len: int | None = None) -> Column:
    """Lower-case ASCII letters and digits; other runs become one separator, none at the ends. Transliterate before, if letters of
    other scripts are to stay (``transliteration.to_ascii``)."""
    out = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", separator), F.lit(separator))
    return F.rtrim(F.substring(out, 1, max_len), F.lit(separator)) if max_len else out


def collapse_whitespace(c: Column, strip: bool = True) -> Column:
    # a blank by itself is left where it is, so there is nothing to put together for most words
    out = F.regexp_replace(c, f" {WHITE}+|(?=[^ ]){WHITE}+", " ")
    return F.trim(out) if strip else out


def normalize_line_endings(c: Column, to: str = "\n") -> Column:
    return F.regexp_replace(c, "\r\n|\r|\n", to)


def strip_controls(c: Column, keep_layout: bool = False) -> Column:
    return F.regexp_replace(c, r"[\p{Cc}&&[^\t\n\r]]" if keep_layout else r"\p{Cc}", "")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\x07]*(?:\x07|\x1b\\\\))", "")


def canonicalize_punctuation(c: Column) -> Column:
    plain = F.translate(c, "‘’‚‛“”„‟‐‑‒–—―−", "''''\"\"\"\"-------")
    return F.replace(plain, F.lit("…"), F.lit("..."))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, REGEX_META, r"\\$1")


def escape_json(c: Column) -> Column:
    """The body of a JSON string, without its quotes."""
    quoted = F.get_json_object(F.to_json(F.struct(F.to_json(F.struct(c.alias("v"))).alias("w"))), "$.w")
    return F.when(c.isNotNull(), F.substring(quoted, F.lit(7), F.length(quoted) - 8))


def percent_decode(c: Column) -> Column:
    """Null where the text isn't validly encoded; ``+`` stays."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def shell_quote(c: Column) -> Column:
    """A POSIX word; the empty text is two quotes."""
    return F.when(c.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def quote(c: Column, mark: str = '"') -> Column:
    return F.concat(F.lit(mark), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit("\\" + mark)), F.lit(mark))


def custom_quote(c: Column, opening: str, closing: str, escape: str = "\\") -> Column:
    """Wrapped in a pair, with ``escape`` before each of the three marks inside."""
    marks = "".join("\\" + m if m in "\\^-[]&" else m for m in dict.fromkeys((opening, closing, escape)))
    return F.concat(F.lit(opening), F.regexp_replace(c, f"([{marks}])", escape.replace("\\", "\\\\").replace("$", "\\$") + "$1"), F.lit(closing))


def single_quote(c: Column) -> Column:
    return custom_quote(c, "'", "'")


def double_quote(c: Column) -> Column:
    return custom_quote(c, '"', '"')


def backtick_quote(c: Column) -> Column:
    return custom_quote(c, "`", "`")


def angle_quote(c: Column) -> Column:
    return custom_quote(c, "<", ">")


def curly_quote(c: Column) -> Column:
    return F.concat(F.lit("“"), c, F.lit("”"))


def curly_single_quote(c: Column) -> Column:
    return F.concat(F.lit("‘"), c, F.lit("’"))


def quote_smart(c: Column) -> Column:
    """The mark that needs the fewest escapes; double before single before backtick on ties."""
    double, single, back = (count_matches(c, m) for m in "\"'`")
    return F.when((single < double) & (single <= back), single_quote(c)).when((back < double) & (back < single), backtick_quote(c)).otherwise(double_quote(c))


_PAIRS = {'"': '"', "'": "'", "`": "`", "<": ">", "“": "”", "‘": "’"}


def is_quoted(c: Column) -> Column:
    """Whether the text begins and ends with the two marks of a pair."""
    last = F.right(c, F.lit(1))
    matching = F.lit(False)
    for opening, closing in _PAIRS.items():
        matching = matching | (F.startswith(c, F.lit(opening)) & (last == closing))
    return (F.length(c) >= 2) & matching


def unquote(c: Column) -> Column:
    """The inside of a matching pair of quotes, else null."""
    return F.when(is_quoted(c), F.substring(c, F.lit(2), F.length(c) - 2))


def is_empty(c: Column) -> Column:
    return F.length(c) == 0


def _each_line(c: Column, change, crlf: bool = True) -> Column:
    """``change`` on every line without its end; ends stay. Without ``crlf``, a CR before LF belongs to the line."""
    lines = F.regexp_extract_all(c, F.lit("([^\n]*\n|[^\n]+)"), F.lit(1))

    def one(x: Column) -> Column:
        end = F.when(F.endswith(x, F.lit("\r\n")), 2 if crlf else 1).when(F.endswith(x, F.lit("\n")), 1).otherwise(0)
        return F.concat(change(F.substring(x, F.lit(1), F.length(x) - end)), F.right(x, end))

    return F.array_join(F.transform(lines, one), "")


def lines_with_terminators(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([^\n]*\n|[^\n]+)"), F.lit(1))


def non_empty_lines(c: Column, white: str = WHITE) -> Column:
    """Lines with something other than white space."""
    return F.filter(split_lines(c), lambda x: trim(x, white) != "")


def trim_lines(c: Column, white: str = WHITE, crlf: bool = True) -> Column:
    return _each_line(c, lambda x: trim(x, white), crlf)


def prefix_lines(c: Column, prefix: str) -> Column:
    return _each_line(c, lambda x: F.concat(F.lit(prefix), x))


def suffix_lines(c: Column, suffix: str, crlf: bool = True) -> Column:
    return _each_line(c, lambda x: F.concat(x, F.lit(suffix)), crlf)


def indent(c: Column, n: int, crlf: bool = True) -> Column:
    """Blanks before every line that isn't empty."""
    return _each_line(c, lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(" " * n), x)), crlf)


def dedent(c: Column, white: str | None = None, most: int | None = None) -> Column:
    """Without the longest white space, of ``most`` characters at most, that all lines with other text begin with; lines of white space
    alone (the characters of ``white``, or Unicode's) become empty."""

    def cut(text: str) -> str:
        lines = text.split("\n")
        least = os.path.commonprefix([x[: len(x) - len(x.lstrip(" \t"))] for x in lines if x.strip(white)])[:most]
        return "\n".join(x[len(least) :] if x.strip(white) else "" for x in lines)

    return text_udf(cut, "string")(c)


def lines_count(c: Column) -> Column:
    return F.size(split_lines(c))


def render(template: str, **values: Column) -> Column:
    """``{name}`` is replaced; ``{{`` and ``}}`` are braces."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def render_positional(template: str, *values: Column) -> Column:
    """``{0}`` is the first value; ``{{`` and ``}}`` are braces."""
    return render(template, **{str(i): v for i, v in enumerate(values)})


def render_permissive(template: str, **values: Column) -> Column:
    """As ``render``, but a name without a value stays as it is, braces included, and so do braces that hold no name."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([^{}]*)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        whole = m[0]
        parts.append(F.lit(whole[0]) if whole in ("{{", "}}") else values[m[1]].cast("string") if m[1] in values else F.lit(whole))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def render_map(c: Column, values: Column) -> Column:
    """A template in a column with a map<string, string>; null where a name has no value."""
    names = F.regexp_extract_all(c, F.lit(r"(?:\{\{|\}\}|\{([^{}]*)\})"), F.lit(0))
    value = lambda n: F.when(n == "{{", F.lit("{")).when(n == "}}", F.lit("}")).otherwise(values[F.substring(n, F.lit(2), F.length(n) - 2)])
    between = F.split(c, r"\{\{|\}\}|\{[^{}]*\}")
    filled = F.zip_with(between, names, lambda a, n: F.when(n.isNull(), a).otherwise(F.concat(a, value(n))))
    return F.when(~F.exists(filled, lambda x: x.isNull()), F.array_join(filled, ""))


def classify_script(c: Column) -> Column:
    """The script most letters have; any kana is Jpan, any Hangul Hang; null without letters."""
    scripts = ("Latn", "IsLatin"), ("Cyrl", "IsCyrillic"), ("Grek", "IsGreek"), ("Arab", "IsArabic"), ("Hebr", "IsHebrew"), ("Deva", "IsDevanagari"), ("Hani", "IsHan"), ("Thai", "IsThai"), ("Armn", "IsArmenian"), ("Geor", "IsGeorgian"), ("Beng", "IsBengali"), ("Taml", "IsTamil"), ("Ethi", "IsEthiopic"), ("Guru", "IsGurmukhi"), ("Gujr", "IsGujarati"), ("Orya", "IsOriya"), ("Telu", "IsTelugu"), ("Knda", "IsKannada"), ("Mlym", "IsMalayalam"), ("Sinh", "IsSinhala"), ("Laoo", "IsLao"), ("Mymr", "IsMyanmar"), ("Khmr", "IsKhmer"), ("Tibt", "IsTibetan"), ("Mong", "IsMongolian")
    counts = F.array(*[F.struct(F.regexp_count(c, F.lit(rf"\p{{{p}}}")).alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("script")) for i, (s, p) in enumerate(scripts)])
    most = F.array_max(counts)
    return F.when(c.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "Jpan").when(c.rlike(r"\p{IsHangul}"), "Hang").when(most["n"] > 0, most["script"])
