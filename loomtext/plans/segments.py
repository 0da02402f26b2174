"""Queries of segmentation, chunking and rolling hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import rolling, segments
from loomtext.operators import chunking
from loomtext.plans.base import query, read, scalar

_c = F.col
#: Letters and blanks alone, where the default word boundaries are those of runs.
_PLAIN_SQL = r"regexp_replace(text, '[^\p{L}\s]', '', 'g')"


def _plain():
    return F.regexp_replace("text", r"(?U)[^\p{L}\s]", "")


scalar("segment_words", "documents", "doc_id", {"words": lambda: F.size(segments.words(_plain())), "bounds": lambda: F.array_join(segments.word_bounds(_plain()), "") == _plain(), "first": lambda: F.get(segments.word_indices(_plain()), F.lit(0))["text"], "at": lambda: F.get(segments.word_indices(_plain()), F.lit(1))["at"], "n": lambda: F.size(segments.word_bound_indices(F.lit("can't 3.5 (a)")))},
    rf"CAST(len(regexp_extract_all({_PLAIN_SQL}, '\p{{L}}+')) AS INT) AS words, true AS bounds, nullif(regexp_extract({_PLAIN_SQL}, '\p{{L}}+'), '') AS first, CAST(CASE WHEN len(regexp_extract_all({_PLAIN_SQL}, '\p{{L}}+')) > 1 THEN length(regexp_extract({_PLAIN_SQL}, '^\P{{L}}*\p{{L}}+\P{{L}}+')) END AS INT) AS at, CAST(7 AS INT) AS n")
#: Sentences of letters with full stops before a blank and a capital.
scalar("segment_sentences", "part", "p_partkey", {"n": lambda: F.size(segments.sentences(F.concat("p_name", F.lit(". The "), "p_type", F.lit("! Is it? e.g. this. 3.5 more.")))), "second": lambda: F.get(segments.sentences(F.concat("p_name", F.lit(". The "), "p_type", F.lit("! So"))), F.lit(1)), "at": lambda: F.get(segments.sentence_indices(F.concat("p_name", F.lit(". The "))), F.lit(1))["at"]},
    "CAST(5 AS INT) AS n, 'The ' || p_type || '! ' AS second, CAST(length(p_name) + 2 AS INT) AS at")
scalar("segment_units", "part", "p_partkey", {"bytes": lambda: F.size(segments.segment(_c("p_name"), "bytes")), "clusters": lambda: F.size(segments.segment(_c("p_name"), "graphemes")), "words": lambda: F.array_join(segments.segment(_c("p_name"), "words"), "|"), "lines": lambda: F.size(segments.segment(F.replace("p_name", F.lit(" "), F.lit("\n")), "lines")), "breaks": lambda: F.array_join(segments.segment(F.concat("p_name", F.lit("-x (y) 1,5")), "line_segments"), "|"), "last": lambda: F.element_at(segments.line_breaks(F.concat("p_name", F.lit("\nx"))), 1)["at"], "must": lambda: F.exists(segments.line_breaks(F.concat("p_name", F.lit("\nx"))), lambda b: b["must"]), "placed": lambda: F.element_at(segments.segments_with_offsets(_c("p_name"), "words"), -1)["at"]},
    "CAST(length(p_name) AS INT) AS bytes, CAST(length(p_name) AS INT) AS clusters, replace(p_name, ' ', '| |') AS words, CAST(len(string_split(p_name, ' ')) AS INT) AS \"lines\", replace(p_name, ' ', ' |') || '-|x |(y) |1,5' AS breaks, CAST(CASE WHEN contains(p_name, ' ') THEN instr(p_name, ' ') ELSE length(p_name) + 1 END AS INT) AS last, true AS must, CAST(length(p_name) - length(string_split(p_name, ' ')[-1]) AS INT) AS placed")
scalar("segment_tokens", "part", "p_partkey", {"ws": lambda: F.array_join(F.transform(segments.whitespace_tokens(F.concat(F.lit(" "), "p_name")), lambda t: F.concat(t["at"].cast("string"), F.lit(":"), t["text"])), "|"), "de": lambda: F.array_join(F.transform(segments.delimiter_tokens(_c("p_name"), " "), lambda t: t["text"]), "|"), "al": lambda: F.array_join(segments.alphanumeric_tokens(_c("p_brand")), "|")},
    "array_to_string(list_transform(string_split(p_name, ' '), lambda w, i: (1 + CASE WHEN i = 1 THEN 0 ELSE length(split_part(p_name, ' ', 1)) + 1 END) || ':' || w), '|') AS ws, replace(p_name, ' ', '|') AS de, replace(p_brand, '#', '|') AS al")
scalar("rolling_hashes", "part", "p_partkey", {"p": lambda: F.array_join(rolling.rolling_hashes(_c("p_name"), 4, "polynomial"), ","), "b": lambda: F.size(rolling.rolling_hashes(_c("p_name"), 4, "buzhash")), "r": lambda: F.array_join(rolling.rolling_hashes(_c("p_name"), 8, "rabin"), ","), "g": lambda: F.size(rolling.rolling_hashes(_c("p_name"), 1, "gear"))},
    "array_to_string(list_transform(range(1, length(p_name) - 2), lambda i: ascii(substr(p_name, CAST(i AS INT), 1)) * 16974593 + ascii(substr(p_name, CAST(i + 1 AS INT), 1)) * 66049 + ascii(substr(p_name, CAST(i + 2 AS INT), 1)) * 257 + ascii(substr(p_name, CAST(i + 3 AS INT), 1))), ',') AS p, CAST(greatest(length(p_name) - 3, 0) AS INT) AS b, array_to_string(list_transform(range(1, length(p_name) - 6), lambda i: list_sum(list_transform(range(0, 8), lambda k: CAST(ascii(substr(p_name, CAST(i + k AS INT), 1)) AS HUGEINT) << (8 * (7 - k))))::BIGINT), ',') AS r, CAST(length(p_name) AS INT) AS g")


@query("SELECT doc_id AS id, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text <> '' GROUP BY doc_id")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks of a text have together is the text."""
    cut = chunking.fastcdc(read(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", cdc=chunking.Cdc.around(64, 256, 1024))
    return cut.groupBy("id").agg(F.sum("size").alias("bytes"))


@query(r"WITH p AS (SELECT doc_id AS id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> '') AS parts FROM documents WHERE len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: length(x) > 2000)) = 0) SELECT id, CAST(i - 1 AS INT) AS chunk, parts[i] AS text FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose paragraphs all fit the size."""
    d = read(spark, sf_dir, "documents").where(~F.exists(F.split("text", "\n\n"), lambda x: F.length(x) > 2000))
    return chunking.split_texts(d, chunking.split_paragraphs, size=2000, id_col="doc_id", text_col="text")


@query("SELECT p_partkey AS id, CAST(i - 1 AS INT) AS chunk, CASE WHEN i = 1 THEN w[1] ELSE right(w[i - 1], 2) || w[i] END AS text FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part WHERE length(p_name) > 8 AND len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 8)) = 0 AND length(p_name) - 1 > 7)")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words that don't fit together, the second behind the end of the first."""
    d = read(spark, sf_dir, "part").where((F.length("p_name") > 8) & ~F.exists(F.split("p_name", " "), lambda x: F.length(x) > 8))
    return chunking.split_texts(d, chunking.split_recursive, size=8, overlap=2, id_col="p_partkey", text_col="p_name")
