r"""Line deduplication with a fixed-depth log-template tree, in DataFrame functions only.

A line is parsed by its token count, then by its first ``depth`` tokens, which lead to a leaf; tokens with a digit
are variable fields and become ``<*>``. Within a leaf, a later token stays constant where it has support: where the
different lines of the leaf with that token at that position lie in ``min_docs`` documents or more (a document counts once for each of its
lines). The others are variable fields too, so lines that differ in a name or two share one template. Lines of up to
2 x ``depth`` tokens are only their own template, and so is a line that would keep fewer than half of its tokens. A template that
occurs in ``min_docs`` documents or more is recurring; its lines are dropped everywhere but
in the document with the smallest id that has it, so that one of many copies stays whole.

Scale: first, a line travels as the 8-byte key of its leaf, counted with map-side
combining; only the lines of leaves that lie in enough documents go on. Tokens are counted once for each different line of
a leaf, so a line in a third of all documents is one row there. Lines and templates are held by 128-bit keys; those of crowded lines are
joined from bounded broadcast tables (``spread``), and documents are counted in salted groups first. The text moves twice: to the
numbers of the lines that go on, and to those of the dropped lines; both joins are on a row's own key.

Edge cases: null text stays null and has no lines; a line with over half of its tokens variable from the start, or without tokens, is
never dropped; a template several times in one document counts once; rows that repeat a doc_id
are one document, equal rows get equal answers; null ids count as no document and are never the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.spread import spread_join
from loomtext.session import materialise

MIN_DOCS = 4
DEPTH = 3
SPACE = r"[\x20\x09-\x0D]+"
VARIABLE = "<*>"
SALTS = 64


def _masked(line: Column) -> Column:
    """The line's tokens joined by blanks, those with a digit as variables."""
    plain = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", VARIABLE)).otherwise(line)
    return F.btrim(F.regexp_replace(plain, SPACE, " "))


def _leaf(masked: Column, min_tokens: int, depth: int) -> Column:
    """The key of the leaf of a line, null if it is never dropped."""

    def key(t: Column) -> Column:
        n = F.size(t)
        return F.when((masked != "") & (n >= min_tokens) & (F.size(F.array_remove(t, VARIABLE)) * 2 >= n), F.xxhash64(n, F.array_join(F.slice(t, F.lit(1), F.lit(depth)), " ")))

    return F.transform(F.array(F.split(masked, " ")), key)[0]


def _row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("_a"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("_b")]


def _wide_hash(c: Column, names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(c).alias(names[0]), F.xxhash64(F.lit(1), c).alias(names[1])]


def _candidates(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_tokens: int, depth: int) -> DataFrame:
    """(_a, _b, _id, _line, _text): the masked lines whose leaf lies in enough rows."""
    # filtered on the text: a filter on the keys would compute them a second time
    some = docs.where(F.col(text_col).isNotNull())
    leaves = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.transform(F.array(_masked(x)), lambda m: _leaf(m, min_tokens, depth))[0])
    lines = materialise(some.select(*_row_key(id_col, text_col), leaves.alias("_leaves")), "line-leaves")
    often = lines.select(F.explode(F.array_distinct(F.array_compact("_leaves"))).alias("_leaf")).groupBy("_leaf").agg(F.count(F.lit(1)).alias("_rows"))
    often = materialise(often.where(F.col("_rows") >= min_docs), "recurring-leaves")
    hit = spread_join(lines.select("_a", "_b", F.posexplode("_leaves").alias("_line", "_leaf")).where("_leaf is not null"), often, ["_leaf"], "_rows")
    picks = hit.groupBy("_a", "_b").agg(F.collect_set("_line").alias("_picks"))
    texts = some.select(*_row_key(id_col, text_col), F.col(id_col).alias("_id"), F.split(F.col(text_col), "\n").alias("_lines")).join(picks, ["_a", "_b"])
    picked = texts.select("_a", "_b", "_id", F.explode(F.transform("_picks", lambda i: F.struct(i.alias("_line"), F.get("_lines", i).alias("_text")))).alias("_p"))
    return materialise(picked.select("_a", "_b", "_id", "_p._line", _masked(F.col("_p._text")).alias("_text")), "candidate-lines")


def _documents(rows: DataFrame, keys: list[str], with_text: bool = False) -> DataFrame:
    """Per key: _docs (how many different ids) and _first (the least), counted in salted groups of ids first; and a _text, if asked for."""
    text = [F.first("_text").alias("_text")] if with_text else []
    parts = rows.groupBy(*keys, F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("_salt")).agg(F.count_distinct("_id").alias("_docs"), F.min("_id").alias("_first"), *text)
    return parts.groupBy(*keys).agg(F.sum("_docs").alias("_docs"), F.min("_first").alias("_first"), *text)


def _templates(candidates: DataFrame, min_docs: int, depth: int) -> DataFrame:
    """(_h, _g, _docs, _k, _l): the keys of each different line and of its template, and the documents that have the line."""
    named = candidates.select("_id", "_text", *_wide_hash(F.col("_text"), ("_h", "_g")))
    different = _documents(named, ["_h", "_g"], with_text=True)
    different = materialise(different.select("_h", "_g", "_text", "_docs", _leaf(F.col("_text"), 1, depth).alias("_leaf"), F.size(F.split("_text", " ")).alias("_n")), "different-lines")
    own = different.select("_h", "_g", "_docs", *_wide_hash(F.col("_text"), ("_k", "_l")))
    tokens = different.where(F.col("_n") > 2 * depth).select("_h", "_g", "_leaf", "_docs", F.posexplode(F.split("_text", " ")).alias("_i", "_y"))
    fixed = tokens.where(F.col("_i") >= depth).groupBy("_leaf", "_i", "_y").agg(F.sum("_docs").alias("_docs")).where(F.col("_docs") >= min_docs).select("_leaf", "_i", "_y", F.lit(True).alias("_fixed"))
    general = tokens.join(fixed, ["_leaf", "_i", "_y"], "left").select("_h", "_g", F.struct("_i", F.when((F.col("_i") < depth) | F.col("_fixed"), F.col("_y")).otherwise(VARIABLE).alias("_y")).alias("_t"))
    general = general.groupBy("_h", "_g").agg(F.transform(F.sort_array(F.collect_list("_t")), lambda t: t["_y"]).alias("_t"))
    general = general.where(F.size(F.array_remove("_t", VARIABLE)) * 2 >= F.size("_t")).select("_h", "_g", *_wide_hash(F.array_join("_t", " "), ("_gk", "_gl")))
    return own.join(general, ["_h", "_g"], "left").select("_h", "_g", "_docs", F.coalesce("_gk", "_k").alias("_k"), F.coalesce("_gl", "_l").alias("_l"))


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = 1, depth: int = DEPTH) -> DataFrame:
    """(_a, _b, _drop): the key of a row, and the numbers of its lines that are dropped."""
    candidates = _candidates(docs, id_col, text_col, min_docs, min_tokens, depth)
    places = candidates.select("_a", "_b", "_id", "_line", *_wide_hash(F.col("_text"), ("_h", "_g")))
    templates = materialise(_templates(candidates, min_docs, depth), "templates")
    named = materialise(spread_join(places, templates, ["_h", "_g"], "_docs").select("_a", "_b", "_id", "_line", "_k", "_l"), "template-lines")
    recurring = materialise(_documents(named, ["_k", "_l"]).where(F.col("_docs") >= min_docs), "recurring-templates")
    hit = spread_join(named, recurring, ["_k", "_l"], "_docs").where(~F.col("_id").eqNullSafe(F.col("_first")))
    return hit.groupBy("_a", "_b").agg(F.collect_set("_line").alias("_drop"))


def _joined(docs: DataFrame, id_col: str, text_col: str, **params: int) -> DataFrame:
    row = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_text"), *_row_key(id_col, text_col))
    drop = dropped_lines(docs, id_col=id_col, text_col=text_col, **params)
    out = row.join(drop, ["_a", "_b"], "left")
    lines = F.split(F.col("_text"), "\n")
    # the dropped numbers in order, with what lies between them: a search per line would be quadratic in a long text
    gone = F.sort_array("_drop")
    starts = F.transform(F.concat(F.array(F.lit(-1)), gone), lambda x: x + 1)
    ends = F.concat(gone, F.array(F.size(lines)))
    between = lambda all_: F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(all_, a + 1, b - a)))
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(F.transform(F.array(lines), between)[0])
    return out.withColumn("_kept", F.when(F.col("_text").isNull(), F.array().cast("array<string>")).otherwise(kept))


def line_dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """Per document: n_lines, n_dropped, and the hex SHA-256 of its kept lines joined by line feeds."""
    df = _joined(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", **params)
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size(F.split(F.col("_text"), "\n")))
    return df.select("_doc.doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"))


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """The documents without their dropped lines. All rows and columns stay; null texts stay null."""
    df = _joined(docs, id_col, text_col, **params)
    text = F.when(F.col("_text").isNotNull(), F.array_join("_kept", "\n"))
    return df.select(*[text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
t0 AS (SELECT doc_id, line, regexp_extract_all(regexp_replace(x, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS w FROM l),
t AS (SELECT *, len(w) AS n, list_slice(w, 1, 3) AS head FROM t0 WHERE len(w) > 0 AND len(list_filter(w, lambda y: y <> '<*>')) * 2 >= len(w)),
leaf AS (SELECT n, head FROM t GROUP BY n, head HAVING count(DISTINCT doc_id) >= 4),
u AS (SELECT n, head, w, count(DISTINCT doc_id) AS docs FROM t SEMI JOIN leaf USING (n, head) GROUP BY n, head, w),
p AS (SELECT n, head, w, docs, unnest(range(1, n + 1)) AS i, unnest(w) AS y FROM u),
fixed AS (SELECT n, head, i, y FROM p WHERE i > 3 GROUP BY n, head, i, y HAVING sum(docs) >= 4),
g AS (SELECT p.n, w, list(CASE WHEN i <= 3 OR p.n < 7 OR fixed.y IS NOT NULL THEN p.y ELSE '<*>' END ORDER BY i) AS general FROM p LEFT JOIN fixed USING (n, head, i, y) GROUP BY p.n, w),
m AS (SELECT w, CASE WHEN len(list_filter(general, lambda y: y <> '<*>')) * 2 >= n THEN general ELSE w END AS k FROM g),
r AS (SELECT k, min(doc_id) AS first_doc FROM t JOIN m USING (w) GROUP BY k HAVING count(DISTINCT doc_id) >= 4),
gone AS (SELECT DISTINCT doc_id, line FROM t JOIN m USING (w) JOIN r USING (k) WHERE doc_id IS DISTINCT FROM first_doc),
agg AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped, coalesce(string_agg(x, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS kept FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN agg USING (doc_id)
"""
