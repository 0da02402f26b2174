"""Every registered query of the core library with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import collation, escapes, formats, grams, kernels, lsh, multisets, sketches, strings, tokens, unicode, wrapping
from loomtext.operators import chunking, joins, nearest
from loomtext.plans import languages, patterns, segments, sequences, texts
from loomtext.plans.base import ORACLES as _ORACLES
from loomtext.plans.base import QUERIES as _QUERIES
from loomtext.plans.base import pair as _pair
from loomtext.plans.base import query as _query
from loomtext.plans.base import read as _read
from loomtext.plans.base import scalar as _scalar

MODULES = (languages, patterns, segments, sequences, texts)

_c = F.col

_scalar("pred_contains", "part", "p_partkey", {"has": lambda: F.contains("p_name", F.lit("a")), "starts": lambda: F.startswith("p_type", F.lit("S")), "ends": lambda: F.endswith("p_type", F.lit("L"))}, "contains(p_name, 'a') AS has, starts_with(p_type, 'S') AS starts, suffix(p_type, 'L') AS ends")
_scalar("search_find", "part", "p_partkey", {"at": lambda: strings.find(_c("p_name"), "e"), "last": lambda: strings.rfind(_c("p_name"), "e"), "n": lambda: strings.count_matches(_c("p_name"), "e")}, "nullif(instr(p_name, 'e'), 0) - 1 AS at, CASE WHEN contains(p_name, 'e') THEN length(p_name) - instr(reverse(p_name), 'e') END AS last, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INT) AS n")
_scalar("search_overlapping", "part", "p_partkey", {"at": lambda: F.array_join(strings.find_overlapping(_c("p_type"), "N"), ",")}, "array_to_string(list_filter(range(0, length(p_type)), lambda i: substr(p_type, CAST(i + 1 AS INT), 1) = 'N'), ',') AS at")
_scalar("search_wildcard", "customer", "c_custkey", {"hit": lambda: strings.wildcard(_c("c_name"), "Cust*1?")}, "regexp_full_match(c_name, 'Cust.*1.', 's') AS hit")
_scalar("str_trim", "customer", "c_custkey", {"t": lambda: strings.trim(F.concat(F.lit(" \t"), "c_name", F.lit("\n "))), "chars": lambda: strings.trim_chars(_c("c_name"), "C0123456789")}, "c_name AS t, trim(c_name, 'C0123456789') AS chars")
_scalar("str_pad", "nation", "n_nationkey", {"l": lambda: strings.pad_left(_c("n_name"), 9, "*"), "r": lambda: strings.pad_right(_c("n_name"), 9, "*"), "m": lambda: strings.center(_c("n_name"), 12, "-")}, "CASE WHEN length(n_name) >= 9 THEN n_name ELSE lpad(n_name, 9, '*') END AS l, CASE WHEN length(n_name) >= 9 THEN n_name ELSE rpad(n_name, 9, '*') END AS r, CASE WHEN length(n_name) >= 12 THEN n_name ELSE repeat('-', CAST((12 - length(n_name)) // 2 AS INT)) || n_name || repeat('-', CAST(12 - length(n_name) - (12 - length(n_name)) // 2 AS INT)) END AS m")
_scalar("str_slice", "part", "p_partkey", {"head": lambda: strings.take_scalars(_c("p_name"), 4), "tail": lambda: strings.drop_scalars(_c("p_name"), 4), "mid": lambda: strings.slice_scalars(_c("p_name"), 2, 5)}, "substr(p_name, 1, 4) AS head, substr(p_name, 5) AS tail, substr(p_name, 3, 3) AS mid")
_scalar("str_split", "part", "p_partkey", {"parts": lambda: F.array_join(strings.split(_c("p_type"), " "), "|"), "n": lambda: F.size(strings.split_whitespace(_c("p_type"))), "head": lambda: strings.split_once(_c("p_type"), " ")["head"]}, "array_to_string(string_split(p_type, ' '), '|') AS parts, CAST(len(string_split(p_type, ' ')) AS INT) AS n, CASE WHEN contains(p_type, ' ') THEN split_part(p_type, ' ', 1) END AS head")
_scalar("str_replace", "part", "p_partkey", {"every": lambda: strings.replace_all(_c("p_type"), "A", "<a>"), "first": lambda: strings.replace_first(_c("p_type"), "A", "<a>"), "mapped": lambda: strings.translate(_c("p_type"), "AEIOU", "aeiou")}, "replace(p_type, 'A', '<a>') AS every, regexp_replace(p_type, 'A', '<a>') AS first, translate(p_type, 'AEIOU', 'aeiou') AS mapped")
_scalar("str_lengths", "documents", "doc_id", {"bytes": lambda: strings.byte_len(_c("text")), "scalars": lambda: strings.scalar_count(_c("text")), "clusters": lambda: strings.grapheme_count(_c("text"))}, "CAST(strlen(text) AS INT) AS bytes, CAST(length(text) AS INT) AS scalars, CAST(length_grapheme(text) AS INT) AS clusters")
_scalar("str_case", "part", "p_partkey", {"lo": lambda: strings.to_lower_ascii(_c("p_type")), "up": lambda: strings.to_upper_ascii(_c("p_name")), "cap": lambda: strings.capitalize(_c("p_name"))}, "lower(p_type) AS lo, upper(p_name) AS up, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS cap")
_scalar("str_lines", "documents", "doc_id", {"n": lambda: strings.lines_count(_c("text"))}, "CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END AS INT) AS n")
_scalar("ident_cases", "part", "p_partkey", {"snake": lambda: strings.to_case(_c("p_type"), "snake"), "kebab": lambda: strings.to_case(_c("p_type"), "kebab"), "slug": lambda: strings.slugify(_c("p_type"))}, "lower(replace(p_type, ' ', '_')) AS snake, lower(replace(p_type, ' ', '-')) AS kebab, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug")
_scalar("norm_whitespace", "documents", "doc_id", {"t": lambda: F.sha2(strings.collapse_whitespace(_c("text")), 256)}, r"sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t")
_scalar("norm_controls", "pages", "page_id", {"t": lambda: F.sha2(strings.strip_controls(_c("html")), 256)}, r"sha256(regexp_replace(html, '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) AS t")
_scalar("norm_diacritics", "documents", "doc_id", {"t": lambda: F.sha2(unicode.strip_diacritics(_c("text")), 256)}, "sha256(strip_accents(text)) AS t")
_scalar("norm_nfc", "documents", "doc_id", {"t": lambda: F.sha2(unicode.nfc(_c("text")), 256)}, "sha256(nfc_normalize(text)) AS t")
_scalar("escape_html", "pages", "page_id", {"t": lambda: F.sha2(strings.escape_html(_c("html")), 256), "back": lambda: escapes.unescape_html(strings.escape_html(_c("html"))) == _c("html")}, "sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS t, true AS back")
_scalar("escape_uri", "pages", "page_id", {"t": lambda: escapes.percent_encode(_c("url")), "back": lambda: strings.percent_decode(escapes.percent_encode(_c("url")))}, "url_encode(url) AS t, url AS back")
_scalar("escape_json", "pages", "page_id", {"t": lambda: F.get_json_object(F.concat(F.lit('{"v":"'), strings.escape_json(_c("html")), F.lit('"}')), "$.v") == _c("html")}, "true AS t")
_scalar("escape_shell", "pages", "page_id", {"t": lambda: strings.shell_quote(_c("url"))}, r"CASE WHEN regexp_full_match(url, '[A-Za-z0-9_@%+=:,./-]+') THEN url ELSE '''' || replace(url, '''', '''\"''\"''') || '''' END AS t".replace('\\"', '"'))
_scalar("escape_regex", "pages", "page_id", {"t": lambda: strings.escape_regex(_c("url"))}, r"regexp_replace(url, '([\\.+*?()|\[\]{}^$#&\-~])', '\\\1', 'g') AS t")
_scalar("quote_render", "nation", "n_nationkey", {"q": lambda: strings.quote(_c("n_name")), "u": lambda: strings.unquote(strings.quote(_c("n_name"))), "r": lambda: strings.render("{{{name}}} in {region}", name=_c("n_name"), region=_c("n_regionkey"))}, "'\"' || n_name || '\"' AS q, n_name AS u, '{' || n_name || '} in ' || n_regionkey AS r")
_scalar("script_detect", "documents", "doc_id", {"s": lambda: strings.classify_script(_c("text"))}, "CASE WHEN regexp_matches(text, '[A-Za-zÀ-ÿ]') THEN 'Latn' END AS s")
_scalar("stats_entropy", "documents", "doc_id", {"h": lambda: F.round(grams.entropy(_c("text")), 6)}, "CAST(round((SELECT coalesce(entropy(ch), 0.0) FROM (SELECT unnest(string_split(text, '')) AS ch)), 6) AS DOUBLE) AS h")
_scalar("stats_ratios", "documents", "doc_id", {"d": lambda: F.round(grams.class_ratio(_c("text"), "0-9"), 9), "p": lambda: F.round(grams.class_ratio(_c("text"), r"\p{P}"), 9)}, r"round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text), 9) AS d, round(length(regexp_replace(text, '\P{P}', '', 'g')) / length(text), 9) AS p")
_scalar("ngram_char", "part", "p_partkey", {"g": lambda: F.array_join(grams.char_ngrams(_c("p_name"), 3), "|")}, "array_to_string(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, CAST(i AS INT), 3)), '|') AS g")
_scalar("ngram_token", "documents", "doc_id", {"n": lambda: F.size(grams.token_ngrams(strings.split_whitespace(_c("text")), 2))}, r"CAST(greatest(len(regexp_extract_all(text, '\S+')) - 1, 0) AS INT) AS n")
_scalar("format_numbers", "orders", "o_orderkey", {"d": lambda: formats.format_decimal(_c("o_totalprice"), 2, "de"), "leap": lambda: formats.is_leap(F.year("o_orderdate")), "dim": lambda: formats.days_in_month(_c("o_orderdate")), "wd": lambda: formats.iso_weekday(_c("o_orderdate"))}, "translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS d, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap, CAST(day(last_day(o_orderdate)) AS INT) AS dim, CAST(isodow(o_orderdate) AS INT) AS wd")
_scalar("plural_rules", "lineitem", "l_orderkey", {"c": lambda: formats.plural_cardinal(_c("l_linenumber"), "ru"), "o": lambda: formats.plural_ordinal_en(_c("l_linenumber"))}, "CASE WHEN l_linenumber % 10 = 1 AND l_linenumber % 100 <> 11 THEN 'one' WHEN l_linenumber % 10 BETWEEN 2 AND 4 AND l_linenumber % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS c, CASE WHEN l_linenumber % 10 = 1 AND l_linenumber % 100 <> 11 THEN 'one' WHEN l_linenumber % 10 = 2 AND l_linenumber % 100 <> 12 THEN 'two' WHEN l_linenumber % 10 = 3 AND l_linenumber % 100 <> 13 THEN 'few' ELSE 'other' END AS o")

def _grams2(c: str):
    return grams.char_ngrams(_c(c), 2)


_G = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, CAST(i AS INT), 2)))"
_gx, _gy = _G.format("x"), _G.format("y")
_pair("dist_levenshtein", {"d": lambda: F.levenshtein("x", "y"), "within": lambda: F.levenshtein("x", "y", 5) >= 0}, "CAST(levenshtein(x, y) AS INT) AS d, levenshtein(x, y) <= 5 AS within")
_pair("dist_hamming", {"d": lambda: grams.hamming(_c("x"), _c("y"))}, "CAST(CASE WHEN length(x) = length(y) THEN hamming(x, y) END AS INT) AS d")
_pair("dist_damerau", {"d": lambda: kernels.damerau("x", "y")}, "CAST(damerau_levenshtein(x, y) AS INT) AS d")
_pair("sim_jaro", {"s": lambda: F.round(kernels.jaro_sim("x", "y"), 9)}, "round(jaro_similarity(x, y), 9) AS s")
_pair("sim_jaro_winkler", {"s": lambda: F.round(kernels.jaro_winkler_boosted_sim("x", "y"), 9)}, "round(jaro_winkler_similarity(x, y), 9) AS s")
_pair("sim_sets", {"j": lambda: F.round(grams.jaccard(_grams2("x"), _grams2("y")), 9), "d": lambda: F.round(grams.dice(_grams2("x"), _grams2("y")), 9), "o": lambda: F.round(grams.overlap(_grams2("x"), _grams2("y")), 9)}, f"round(len(list_intersect({_gx}, {_gy})) / len(list_distinct({_gx} || {_gy})), 9) AS j, round(2 * len(list_intersect({_gx}, {_gy})) / (len({_gx}) + len({_gy})), 9) AS d, round(len(list_intersect({_gx}, {_gy})) / least(len({_gx}), len({_gy})), 9) AS o")


_PHRASE = "lower(c_mktsegment) || ' ' || regexp_replace(lower(c_name), '#0*', ' ')"


@_query(f"WITH t AS (SELECT DISTINCT {_PHRASE} AS x, {_G.format('(' + _PHRASE + ')')} AS g FROM customer), s AS (SELECT DISTINCT regexp_replace(lower(s_name), 'supplier#0*', 'building customer ') AS y, list_distinct(list_transform(range(1, length(regexp_replace(lower(s_name), 'supplier#0*', 'building customer '))), lambda i: substr(regexp_replace(lower(s_name), 'supplier#0*', 'building customer '), CAST(i AS INT), 2))) AS h FROM supplier) SELECT x AS l_id, y AS r_id, round(len(list_intersect(g, h)) / len(list_distinct(g || h)), 9) AS jaccard_sim FROM t, s WHERE len(list_intersect(g, h)) / len(list_distinct(g || h)) >= 0.9")
def join_qgram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's segment and number against suppliers put in the same words: tables that grow, with grams that most rows share."""
    phrase = F.concat(F.lower("c_mktsegment"), F.lit(" "), F.regexp_replace(F.lower("c_name"), "#0*", " "))
    c = _read(spark, sf_dir, "customer").select(phrase.alias("name")).distinct()
    s = _read(spark, sf_dir, "supplier").select(F.regexp_replace(F.lower("s_name"), "supplier#0*", "building customer ").alias("name")).distinct()
    sets = lambda df: df.select("name", grams.char_ngrams(F.col("name"), 2).alias("grams"))
    return joins.jaccard_join(sets(c), sets(s), id_col="name", gram_col="grams", threshold=0.9).withColumn("jaccard_sim", F.round("jaccard_sim", 9))


@_query("SELECT c_custkey AS l_id, s_suppkey AS r_id, CAST(levenshtein(c_name, replace(s_name, 'Supplier', 'Customer')) AS INT) AS lev_dist FROM customer, supplier WHERE levenshtein(c_name, replace(s_name, 'Supplier', 'Customer')) <= 1")
def join_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"))
    return joins.edit_join(c, s, id_col="id", text_col="name", distance=1)


@_query("WITH c AS (SELECT c_custkey AS id, lower(c_mktsegment) || c_custkey AS t FROM customer), s AS (SELECT s_suppkey AS id, 'household' || s_suppkey AS t FROM supplier) SELECT c.id AS l_id, s.id AS r_id, CAST(levenshtein(c.t, s.t) AS INT) AS lev_dist FROM c, s WHERE levenshtein(c.t, s.t) <= 2")
def join_edit_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string")).alias("t"))
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("household"), F.col("s_suppkey").cast("string")).alias("t"))
    return joins.edit_join(c, s, id_col="id", text_col="t", distance=2)


@_query("WITH n AS (SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\\S+'))) AS k FROM documents) SELECT k, count(*) AS n FROM n GROUP BY k")
def agg_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.size(F.array_distinct(strings.split_whitespace(_c("text")))).cast("long").alias("k"))
    return d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ch")
def agg_char_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


_SETS = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS g FROM w),
c AS (SELECT g, min(doc_id) AS class_id FROM g GROUP BY g),
e AS (SELECT class_id, unnest(g) AS s, len(g) AS n FROM c),
p AS (SELECT a.class_id AS u, b.class_id AS v, a.n + b.n AS both_n, count(*) AS shared FROM e a JOIN e b USING (s) WHERE a.class_id < b.class_id GROUP BY ALL),
k AS (SELECT u, v FROM p WHERE shared / (both_n - shared) >= 0.8),
l AS (SELECT u, v FROM k UNION ALL SELECT v, u FROM k),
r AS (SELECT class_id AS node, class_id AS seen FROM c UNION SELECT node, l.v FROM r JOIN l ON seen = l.u),
t AS (SELECT node, min(seen) AS group_id FROM r GROUP BY node)
SELECT doc_id AS id, c.class_id, group_id, (SELECT count(*) FROM l WHERE l.u = c.class_id) AS n_links FROM g JOIN c USING (g) JOIN t ON node = class_id"""


def _shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(grams.token_ngrams(strings.split_whitespace(F.lower("text")), 5)).alias("g"))


@_query(_SETS)
def sketch_minhash_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.near_duplicate_classes(_shingles(spark, sf_dir), id_col="doc_id", gram_col="g", threshold=0.8)


_SLOTS = ", ".join(f"({i}, {int(x)}::UHUGEINT)" for i, x in enumerate(sketches._slots(0, 64)))
# FNV-1a and SplitMix64 in SQL, on unsigned 128-bit numbers that are cut to 64 bits
_CUT = "18446744073709551616::UHUGEINT"
_PORTABLE = f"""WITH g AS (SELECT p_partkey AS doc_id, unnest(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, CAST(i AS INT), 3)))) AS g FROM part),
b AS (SELECT doc_id, list_reduce([{int(sketches._FNV_BASIS)}::UHUGEINT] || list_transform(range(1, strlen(g) + 1), lambda i: ('0x' || substr(hex(encode(g)), CAST(2 * i - 1 AS INT), 2))::INT::UHUGEINT), lambda h, x: (xor(h, x) * {int(sketches._FNV_PRIME)}::UHUGEINT) % {_CUT}) AS base FROM g),
h AS (SELECT doc_id, i, xor(base, p) AS x FROM b, (VALUES {_SLOTS}) s(i, p)),
z1 AS (SELECT doc_id, i, (x + {0x9E3779B97F4A7C15}::UHUGEINT) % {_CUT} AS z FROM h),
z2 AS (SELECT doc_id, i, (xor(z, z >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {_CUT} AS z FROM z1),
z3 AS (SELECT doc_id, i, (xor(z, z >> 27) * {0x94D049BB133111EB}::UHUGEINT) % {_CUT} AS z FROM z2),
z4 AS (SELECT doc_id, i, xor(z, z >> 31) AS z FROM z3),
s AS (SELECT doc_id, i, min(z) AS least, 2 * sum(CASE WHEN z >= 9223372036854775808::UHUGEINT THEN 1 ELSE 0 END) >= count(*) AS vote FROM z4 GROUP BY ALL),
o AS (SELECT doc_id, string_agg(CAST(CASE WHEN least >= 9223372036854775808::UHUGEINT THEN least::HUGEINT - 18446744073709551616::HUGEINT ELSE least::HUGEINT END AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i < 16) AS m, string_agg(CASE WHEN vote THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS s FROM s GROUP BY doc_id)
SELECT doc_id, m, s FROM o"""


@_query(_PORTABLE)
def sketch_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "part").select(_c("p_partkey").alias("doc_id"), F.array_distinct(grams.char_ngrams(_c("p_name"), 3)).alias("g"))
    return d.select("doc_id", F.array_join(sketches.minhash(_c("g"), 16), ",").alias("m"), F.lpad(F.bin(sketches.simhash(_c("g"))), 64, "0").alias("s"))


@_query()
def sketch_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.one_permutation_rows(_shingles(spark, sf_dir), id_col="doc_id", gram_col="g", k=16)


_scalar("collate_keys", "customer", "c_custkey", {"ci": lambda: collation.ascii_ci_key(_c("c_name")), "nat": lambda: collation.natural_key(_c("c_name")), "de2": lambda: collation.din5007_key(_c("c_name"), 2), "lib": lambda: collation.library_key(_c("c_name"))}, "lower(c_name) AS ci, array_to_string(list_transform(regexp_extract_all(c_name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(CAST(length(CAST(CAST(x AS BIGINT) AS VARCHAR)) AS VARCHAR), 10, '0') || CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE x END), '') AS nat, lower(c_name) AS de2, regexp_replace(lower(c_name), '([0-9])', '{\\1', 'g') AS lib")
_scalar("token_limits", "part", "p_partkey", {"right": lambda: F.array_join(tokens.truncate(F.split("p_name", ""), 5), ""), "left": lambda: F.array_join(tokens.truncate(F.split("p_name", ""), 5, "left"), ""), "n": lambda: F.size(tokens.pad(F.transform(F.split("p_name", ""), F.ascii), 32, 0))}, "left(p_name, 5) AS \"right\", right(p_name, 5) AS \"left\", CAST(greatest(length(p_name), 32) AS INT) AS n")


@_query(
    "WITH a AS (SELECT p_partkey, x, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS x FROM part) GROUP BY ALL), b AS (SELECT p_partkey, x, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(lower(p_type), '')) AS x FROM part) GROUP BY ALL) "
    "SELECT p_partkey, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS shared, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))), 9) AS j, round(sum(coalesce(a.n, 0) * coalesce(b.n, 0)) / sqrt(sum(coalesce(a.n, 0) ** 2) * sum(coalesce(b.n, 0) ** 2)), 9) AS c FROM a FULL JOIN b USING (p_partkey, x) GROUP BY p_partkey"
)
def gram_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: multisets.multiset(F.split(F.lower(c), ""))
    p = _read(spark, sf_dir, "part").select("p_partkey", of("p_name").alias("a"), of("p_type").alias("b"))
    a, b = _c("a"), _c("b")
    return p.select("p_partkey", multisets.total_count(multisets.intersection_min(a, b)).alias("shared"), F.round(multisets.jaccard_multiset(a, b), 9).alias("j"), F.round(multisets.cosine(a, b), 9).alias("c"))


@_query("SELECT doc_id AS id, count(*) AS grams, CAST(sum(n) AS BIGINT) AS total, round(sqrt(sum(n * n)), 6) AS norm FROM (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS g FROM documents) GROUP BY ALL) GROUP BY doc_id")
def gram_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", strings.split_whitespace(_c("text")).alias("g"))
    n = multisets.gram_counts(d, id_col="doc_id", gram_col="g")
    return n.groupBy("id").agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("total"), F.round(F.sqrt(F.sum(_c("n") * _c("n"))), 6).alias("norm"))


@_query(
    "WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS dist FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0 AND q.vec_id <> i.vec_id) "
    "SELECT query_id, item_id, dist, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id) AS r FROM p) WHERE r <= 5"
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "embeddings")
    return nearest.nearest(items.where("vec_id % 100 = 0"), items, id_col="vec_id", vector_col="embedding", k=5)


#: The embeddings' size; the query's SQL holds the coefficients drawn for it.
_DIM = 64
_DRAWN, _SHIFT = lsh.projection(_DIM, 4.0)
_DOT = f"list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * {list(_DRAWN)}[i]))"


@_query(f"SELECT vec_id, CASE WHEN len(embedding) = {_DIM} THEN CAST(floor(({_DOT} + {_SHIFT!r}) / 4.0) AS BIGINT) END AS bucket FROM embeddings")
def sketch_p_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", lsh.p_stable_bucket(_c("embedding"), _DIM, 4.0).alias("bucket"))


@_query()
def sketch_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "").alias("g"))
    n = multisets.gram_counts(p, id_col="p_partkey", gram_col="g")
    w = n.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gram", _c("n").cast("double")))).alias("w"))
    return w.select(_c("id").alias("p_partkey"), lsh.weighted_minhash(_c("w"), 8).alias("sketch"))


@_query()
def wrap_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(wrapping.wrap(_c("text"), 72)).alias("n"), F.sha2(wrapping.reflow(_c("text"), 72), 256).alias("t"))


@_query()
def chunk_fastcdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fastcdc(_read(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", cdc=chunking.Cdc.preset("8k"))


@_query()
def split_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_texts(_read(spark, sf_dir, "documents"), chunking.split_recursive, size=512, id_col="doc_id", text_col="text")


@_query()
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_texts(_read(spark, sf_dir, "documents"), chunking.split_sentences, size=512, id_col="doc_id", text_col="text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
