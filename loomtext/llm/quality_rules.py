r"""Line-first quality cleaning, in DataFrame functions only.

Each line is tested by itself: a line fails when it lacks end punctuation, looks like
navigation, is boilerplate, is mostly symbols, is all upper case, repeats an earlier line or (in a
text with repeated 3-word windows) is a few words said over and over. Failing lines are removed; a document that loses more than
``max_lost`` of its word characters is rejected. The document-level base test comes first:
fewer than ``min_words`` words, or more than half of the words inside repeated 3-word windows.

Scale: everything is computed within the row; there is no shuffle. Work in a row is linear but for
sorts: of 3-word windows, which only rows with a repeated window pay, and in cleaning, of the lines of rows that lose some.

Edge cases: a null text has no words, so it fails the base test; so does an empty one. Repeated
rows are answered each. Only ``doc_id`` and the text are read by the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_LOST = 0.5
SPACE = r"[\x20\x09-\x0D]+"

#: Lines ending like this are sentences.
END = r"[.!?:;…\"')\]][\x20\x09-\x0D]*$"
BOILERPLATE = r"(?i)\b(licensed under|under the [a-z0-9 .-]* licen[cs]e|all rights reserved|cookie policy|privacy policy|terms of (use|service)|subscribe to our|click here|sign in to|enable javascript|lorem ipsum)"
NAVIGATION = r"( [|<>] [^|<>]*){2}"
SYMBOLS = "#*$%&|<>"
THREE_WORDS = r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2}[^\x20\x09-\x0D]"
#: A lower-case letter of the Latin blocks.
LOWER = r"[a-zß-öø-ÿ]"


def _words(text: Column) -> Column:
    """Words of a text that isn't null; trimming first leaves no empty strings to filter."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _window_hashes(words: str) -> Column:
    n = F.size(words)
    at = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), at)).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(words: str, windows: str) -> Column:
    """Words in repeated windows. Windows with different hashes differ; equal hashes are held against the words."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda i, j: (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    def covered(s: Column) -> Column:
        def pair(x: Column, j: Column) -> Column:
            before = F.get(s, j - 1)
            return F.when((x["h"] == before["h"]) & same(x["i"], before["i"]), F.array(x["i"], before["i"]))

        again = F.array_distinct(F.flatten(F.array_compact(F.transform(s, pair))))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

    # the one-element array binds the sorted windows to a name, so that they are sorted once
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.transform(F.array(placed), covered)[0])


def _line_fails(line: Column, symbols_in_text: Column, repeats_in_text: Column) -> Column:
    long = line.rlike(THREE_WORDS)
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    monotonous = F.transform(F.array(_words(line)), lambda w: (F.size(w) >= 10) & (F.size(F.array_distinct(w)) * 3 < F.size(w)))[0]
    return (
        (long & ~line.rlike(END))
        | (long & ~line.rlike(LOWER) & line.rlike("[A-Z]"))
        | ((symbols_in_text > 0) & (line.rlike(NAVIGATION) | (symbols * 20 > F.length(line))))
        | ((repeats_in_text > 0) & monotonous)
        | line.rlike(BOILERPLATE)
    )


def _firsts(full: str) -> Column:
    """Of structs (i, x) in order of i, the first of each x, still in that order."""
    lines = F.transform(full, lambda s: s["x"])

    def first(placed: Column) -> Column:
        lead = F.filter(placed, lambda s, j: (j == 0) | (s["x"] != F.get(placed, j - 1)["x"]))
        return F.sort_array(F.transform(lead, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"))))

    placed = F.sort_array(F.transform(full, lambda s: F.struct(s["x"].alias("x"), s["i"].alias("i"))))
    return F.when(F.size(F.array_distinct(lines)) == F.size(full), F.col(full)).otherwise(F.transform(F.array(placed), first)[0])


def _scored(docs: DataFrame, text_col: str, min_words: int, max_lost: float, with_places: bool = False) -> DataFrame:
    """``docs`` with the columns _lines, _good (the earliest of equal lines, without those that fail) and _q (a struct of the
    report's values). ``with_places`` makes _lines and _good structs of a line's number i and text x."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = lambda c: F.length(F.translate(c, " \t\n\x0b\x0c\r", ""))
    of = (lambda s: s["x"]) if with_places else (lambda x: x)
    lines = F.split(text, "\n")
    if with_places:
        lines = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    df = docs.withColumn("_w", _words(text)).withColumn("_lines", lines).withColumn("_sym", F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
    n = F.size("_w")
    df = df.withColumn("_win", _window_hashes("_w"))
    full = F.filter("_lines", lambda x: of(x).rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_rep", _repeat_words("_w", "_win")).withColumn("_full", full)
    # the earliest of equal lines is tested, later ones fail as repeats
    df = df.withColumn("_first", _firsts("_full") if with_places else F.array_distinct("_full"))
    df = df.withColumn("_good", F.filter("_first", lambda x: ~_line_fails(of(x), F.col("_sym"), F.col("_rep"))))
    n_words, total = n.cast("long"), chars(text).cast("long")
    failed = (n < min_words) | (F.lit(100) * F.col("_rep") > F.lit(50) * n)
    good = F.transform("_good", of) if with_places else F.col("_good")
    lost = total - F.coalesce(chars(F.array_join(good, "")), F.lit(0))
    kept = ~failed & (lost.cast("double") <= F.lit(max_lost) * total.cast("double"))
    return df.withColumn(
        "_q",
        F.struct(
            n_words.alias("n_words"),
            total.alias("word_chars"),
            F.col("_sym").cast("long").alias("n_symbols"),
            (F.size("_full") - F.size("_first")).cast("long").alias("n_dup_lines"),
            F.col("_rep").cast("long").alias("n_repeat_words"),
            failed.alias("base_failed"),
            kept.alias("kept"),
        ),
    )


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_lost: float = MAX_LOST) -> DataFrame:
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _scored(df, "text", min_words, max_lost).select("doc_id", "_q.*")


def clean_documents(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS, max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that pass, with their failing lines removed; blank lines stay. All columns stay."""
    names = docs.columns
    scored = _scored(docs.select(F.struct(*names).alias("_doc"), F.col(text_col).alias("_text")), "_text", min_words, max_lost, with_places=True)
    blank = F.filter("_lines", lambda s: ~s["x"].rlike(r"[^\x20\x09-\x0D]"))
    left = F.array_join(F.transform(F.sort_array(F.concat(blank, "_good")), lambda s: s["x"]), "\n")
    # A filter would be pushed below the steps above with their expressions written out in it many times
    # over; one on a column that isn't deterministic stays here.
    scored = scored.withColumn("_nth", F.monotonically_increasing_id()).where("_q.kept and _nth >= 0")
    text = F.when(F.size("_good") == F.size("_full"), F.col("_text")).otherwise(left)
    return scored.select(*[text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in names])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT *, row_number() OVER () AS rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d),
win AS (SELECT rid, i, list_slice(w, i, i + 2) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM e WHERE len(w) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
lines AS (SELECT DISTINCT rid, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT rid, unnest(full_lines) AS x FROM e)),
good AS (SELECT lines.rid, sum(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) AS c FROM lines LEFT JOIN rep ON rep.rid = lines.rid WHERE NOT (
    (len(lw) >= 3 AND NOT regexp_matches(x, '[.!?:;…"'')\]][\x20\x09-\x0D]*$'))
    OR (len(lw) >= 3 AND NOT regexp_matches(x, '[a-zß-öø-ÿ]') AND regexp_matches(x, '[A-Z]'))
    OR regexp_matches(x, '( [|<>] [^|<>]*){2}')
    OR length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 20 > length(x)
    OR (coalesce(rep.n, 0) > 0 AND len(lw) >= 10 AND len(list_distinct(lw)) * 3 < len(lw))
    OR regexp_matches(x, '(?i)\b(licensed under|under the [a-z0-9 .-]* licen[cs]e|all rights reserved|cookie policy|privacy policy|terms of (use|service)|subscribe to our|click here|sign in to|enable javascript|lorem ipsum)')
    ) GROUP BY lines.rid),
r AS (SELECT e.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(c, 0) AS c FROM e LEFT JOIN rep USING (rid) LEFT JOIN good USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - c <= 0.5 * word_chars AS kept FROM r
"""
