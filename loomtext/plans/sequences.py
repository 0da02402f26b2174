"""Queries of distances, alignments, sketches, diffs and joins over sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext import registry
from loomtext.functions import alignment, grams, kernels, learned, multisets, phonetic, sketches
from loomtext.operators import diff, joins
from loomtext.plans.base import NAME_PAIRS, name_pairs, pair, query, read, scalar

_c = F.col
# Dynamic programmes in SQL: one list per row of the matrix, folded over the letters of x. What a cell takes from its left is a
# prefix maximum (or minimum) over what the cells take from above.
_LCS = """CAST(list_last(list_reduce([list_transform(range(0, length(y) + 1), lambda j: 0)] || list_transform(string_split(x, ''), lambda p: list_transform(string_split(y, ''), lambda q: CASE WHEN p = q THEN 1 ELSE 0 END)), lambda last, m: [0] || list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(last[k + 1], last[k] + m[k])))))) AS INT)"""
_NW = """CAST(list_last(list_reduce([list_transform(range(0, length(y) + 1), lambda j: -j)] || list_transform(string_split(x, ''), lambda p: list_transform(string_split(y, ''), lambda q: CASE WHEN p = q THEN 1 ELSE -1 END)), lambda last, m: list_transform(range(0, length(y) + 1), lambda j: greatest(last[1] - 1 - j, coalesce(list_max(list_transform(range(1, j + 1), lambda k: greatest(last[k + 1] - 1, last[k] + m[k]) - (j - k))), -1000000))))) AS INT)"""
_SW = """CAST(list_last(list_reduce([list_transform(range(0, length(y) + 2), lambda j: 0)] || list_transform(string_split(x, ''), lambda p: list_transform(string_split(y, ''), lambda q: CASE WHEN p = q THEN 1 ELSE -1 END)), lambda last, m: list_transform([0] || list_transform(range(1, length(y) + 1), lambda j: greatest(0, list_max(list_transform(range(1, j + 1), lambda k: greatest(0, last[k + 1] - 1, last[k] + m[k]) - (j - k))))), lambda v: v) || [greatest(last[length(y) + 2], list_max(list_transform(range(1, length(y) + 1), lambda j: greatest(0, list_max(list_transform(range(1, j + 1), lambda k: greatest(0, last[k + 1] - 1, last[k] + m[k]) - (j - k)))))))])) AS INT)"""
_OSA = """CAST(list_last(list_reduce([list_transform(range(0, 2 * length(y) + 2), lambda j: CASE WHEN j <= length(y) THEN 1000 ELSE j - length(y) - 1 END)] || list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(y) + 1), lambda j: CASE WHEN substr(x, CAST(i AS INT), 1) = substr(y, CAST(j AS INT), 1) THEN 0 ELSE 1 END) || list_transform(range(1, length(y) + 1), lambda j: CASE WHEN i > 1 AND j > 1 AND substr(x, CAST(i - 1 AS INT), 1) = substr(y, CAST(j AS INT), 1) AND substr(x, CAST(i AS INT), 1) = substr(y, CAST(j - 1 AS INT), 1) THEN 1 ELSE 1000 END)), lambda s, m: list_slice(s, length(y) + 2, 2 * length(y) + 2) || list_transform(range(0, length(y) + 1), lambda j: least(s[length(y) + 2] + 1 + j, coalesce(list_min(list_transform(range(1, j + 1), lambda k: least(s[length(y) + 2 + k] + 1, s[length(y) + 1 + k] + m[k], CASE WHEN k > 1 THEN s[k - 1] + m[length(y) + k] ELSE 1000 END) + (j - k))), 1000000))))) AS INT)"""

pair("dist_osa", {"d": lambda: kernels.osa("x", "y"), "near": lambda: kernels.osa_within(_c("x"), _c("y"), 12)}, f"{_OSA} AS d, CASE WHEN {_OSA} <= 12 THEN {_OSA} END AS near")
pair("dist_lcs", {"n": lambda: kernels.lcs("x", "y"), "d": lambda: kernels.lcs_distance(_c("x"), _c("y"))}, f"{_LCS} AS n, CAST(length(x) + length(y) - 2 * {_LCS} AS INT) AS d")
pair("align_scores", {"nw": lambda: kernels.nw_score("x", "y"), "sw": lambda: kernels.sw_score("x", "y")}, f"{_NW} AS nw, {_SW} AS sw")
# with a gap of -1 to open and -1 for each letter; a second list holds the scores that end in a deletion
_AFFINE = """CAST(list_reduce([[0] || list_transform(range(1, length(y) + 1), lambda j: -1 - j) || list_transform(range(0, length(y) + 1), lambda j: -1000000)] || list_transform(string_split(x, ''), lambda p: list_transform(string_split(y, ''), lambda q: CASE WHEN p = q THEN 1 ELSE -1 END)), lambda s, m: [CASE WHEN s[1] = 0 THEN -2 ELSE s[1] - 1 END] || list_transform(range(1, length(y) + 1), lambda j: greatest(greatest(s[j] + m[j], s[length(y) + 2 + j] - 1, s[j + 1] - 2), CASE WHEN s[1] = 0 THEN -2 ELSE s[1] - 1 END - 1 - j, coalesce(list_max(list_transform(range(1, j), lambda k: greatest(s[k] + m[k], s[length(y) + 2 + k] - 1, s[k + 1] - 2) - 1 - (j - k))), -1000000))) || [-1000000] || list_transform(range(1, length(y) + 1), lambda k: greatest(s[length(y) + 2 + k] - 1, s[k + 1] - 2)))[length(y) + 1] AS INT)"""
_AFFINE_LOCAL = """CAST(list_last(list_reduce([list_transform(range(0, length(y) + 1), lambda j: 0) || list_transform(range(0, length(y) + 1), lambda j: -1000000) || [0]] || list_transform(string_split(x, ''), lambda p: list_transform(string_split(y, ''), lambda q: CASE WHEN p = q THEN 1 ELSE -1 END)), lambda s, m: [0] || list_transform(range(1, length(y) + 1), lambda j: greatest(0, greatest(s[j] + m[j], s[length(y) + 2 + j] - 1, s[j + 1] - 2), 0 - 1 - j, coalesce(list_max(list_transform(range(1, j), lambda k: greatest(s[k] + m[k], s[length(y) + 2 + k] - 1, s[k + 1] - 2) - 1 - (j - k))), -1000000))) || [-1000000] || list_transform(range(1, length(y) + 1), lambda k: greatest(s[length(y) + 2 + k] - 1, s[k + 1] - 2)) || [greatest(s[2 * length(y) + 3], list_max(list_transform(range(1, length(y) + 1), lambda j: greatest(0, greatest(s[j] + m[j], s[length(y) + 2 + j] - 1, s[j + 1] - 2), 0 - 1 - j, coalesce(list_max(list_transform(range(1, j), lambda k: greatest(s[k] + m[k], s[length(y) + 2 + k] - 1, s[k + 1] - 2) - 1 - (j - k))), -1000000)))))])) AS INT)"""
pair("align_affine", {"nw": lambda: alignment.score_column(_c("x"), _c("y")), "sw": lambda: alignment.score_column(_c("x"), _c("y"), local=True)}, f"{_AFFINE} AS nw, {_AFFINE_LOCAL} AS sw")
pair("align_script", {"score": lambda: alignment.align_column(_c("x"), _c("y"))["score"], "a": lambda: alignment.extract(alignment.align_column(_c("x"), _c("y"))["script"], "a"), "b": lambda: alignment.extract(alignment.align_column(_c("x"), _c("y"))["script"], "b"), "local": lambda: F.contains(_c("x"), alignment.extract(alignment.align_column(_c("x"), _c("y"), local=True)["script"], "a"))}, f"{_AFFINE} AS score, x AS a, y AS b, true AS local")
pair("align_linear", {"nw": lambda: alignment.score_column(_c("x"), _c("y"), alignment.LINEAR), "sw": lambda: alignment.score_column(_c("x"), _c("y"), alignment.LINEAR, local=True), "script": lambda: alignment.align_column(_c("x"), _c("y"), alignment.LINEAR)["score"], "a": lambda: alignment.extract(alignment.align_column(_c("x"), _c("y"), alignment.LINEAR)["script"], "a")}, f"{_NW} AS nw, {_SW} AS sw, {_NW} AS script, x AS a")
pair("dist_bytes", {"lev": lambda: kernels.levenshtein_bytes(F.concat(F.lit("é"), "x"), F.concat(F.lit("e"), "y")), "osa": lambda: kernels.osa_bytes(F.concat(F.lit("é"), "x"), F.concat(F.lit("ê"), "x")), "ham": lambda: grams.hamming(kernels.as_bytes(_c("x")), kernels.as_bytes(F.concat(F.left("x", F.length("x") - 1), F.lit("!")))), "cut": lambda: kernels.within(F.levenshtein("x", "y"), 15)}, "CAST(levenshtein('é' || x, 'e' || y) AS INT) AS lev, CAST(1 AS INT) AS osa, CAST(CASE WHEN right(x, 1) = '!' THEN 0 ELSE 1 END AS INT) AS ham, CASE WHEN levenshtein(x, y) <= 15 THEN CAST(levenshtein(x, y) AS INT) END AS cut")
pair("sim_jaro_custom", {"s": lambda: F.round(kernels.jaro_winkler_custom(_c("x"), _c("y"), boost_from=0.7), 9), "c": lambda: F.round(kernels.jaro_winkler_sim("x", "y"), 9) >= F.round(kernels.jaro_sim("x", "y"), 9)}, "round(jaro_winkler_similarity(x, y), 9) AS s, true AS c")
pair("sim_distances", {"j": lambda: F.round(grams.jaccard_distance(F.split("x", ""), F.split("y", "")), 9), "n": lambda: grams.intersection_size(F.split("x", ""), F.split("y", ""))}, "round(1 - len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / len(list_distinct(string_split(x, '') || string_split(y, ''))), 9) AS j, CAST(len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) AS INT) AS n")
# events of an alphabet with 64 letters are equally likely: each costs log(65 * 65)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 #"
pair("dist_learned", {"d": lambda: F.round(learned.learned_distance(_c("x"), F.lit("Supplier#1"), learned.LearnedModel.uniform(_ALPHABET)), 6), "far": lambda: learned.learned_distance(F.concat("x", F.lit("é")), _c("y"), learned.LearnedModel.uniform(_ALPHABET)) == float("inf")}, "round(ln(65 * 65) * (1 + greatest(length(x), 10)), 6) AS d, true AS far")
pair("dist_registry", {"d": lambda: registry.require_metric("levenshtein").of(_c("x"), _c("y"))}, "CAST(levenshtein(x, y) AS INT) AS d")
_MULTISETS = """CAST(length(x) + length(y) AS BIGINT) AS sum_, CAST(list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: greatest(length(x) - length(replace(x, c, '')) - (length(y) - length(replace(y, c, ''))), 0))) AS BIGINT) AS less, CAST(length(x) + length(y) - list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) AS BIGINT) AS most, CAST(len(list_distinct(string_split(x, ''))) AS INT) AS kinds, round(2.0 * list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) / (length(x) + length(y)), 9) AS dice, 1.0::DOUBLE AS l1, 1.0::DOUBLE AS l2, 0.0::DOUBLE AS cd"""


@query(f"SELECT id, {_MULTISETS} FROM {NAME_PAIRS}")
def multiset_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = name_pairs(spark, sf_dir).select("id", _bag("x").alias("a"), _bag("y").alias("b"))
    bags = bags.withColumn("w", F.transform_values("a", lambda _, v: v.cast("double")))
    bags = bags.withColumn("u1", multisets.normalize_l1(_c("w"))).withColumn("u2", multisets.normalize_l2(_c("w")))
    a, b = _c("a"), _c("b")
    counts = [multisets.total_count(multisets.union_sum(a, b)).alias("sum_"), multisets.total_count(multisets.difference_saturating(a, b)).alias("less"), multisets.total_count(multisets.union_max(a, b)).alias("most"), multisets.distinct_count(a).alias("kinds")]
    one = F.aggregate(F.map_values("u1"), F.lit(0.0), lambda s, v: s + v)
    return bags.select("id", *counts, F.round(multisets.dice_multiset(a, b), 9).alias("dice"), F.round(one, 9).alias("l1"), F.round(multisets.dot(_c("u2"), _c("u2")), 9).alias("l2"), F.round(multisets.cosine_distance(a, a), 9).alias("cd"))


def _bag(c: str):
    return multisets.multiset(F.split(_c(c), ""))


pair("diff_scripts", {"kept": lambda: F.array_join(F.transform(F.filter(diff.diff_at(_c("x"), _c("y"), "characters"), lambda e: e["op"] != "insert"), lambda e: e["value"]), ""), "made": lambda: F.array_join(F.transform(F.filter(diff.diff_at(_c("x"), _c("y"), "words", "patience"), lambda e: e["op"] != "delete"), lambda e: e["value"]), ""), "changes": lambda: F.size(F.filter(diff.diff_at(_c("x"), _c("y"), "characters"), lambda e: e["op"] != "keep")), "patched": lambda: diff.patched(F.concat("x", F.lit("\n")), diff.diff_lines_unified(F.concat("x", F.lit("\n")), F.concat("y", F.lit("\n")))), "same": lambda: diff.diff_lines_unified(_c("x"), _c("x")), "bad": lambda: diff.patched(F.lit("z\n"), diff.diff_lines_unified(F.concat("x", F.lit("\n")), F.concat("y", F.lit("\n"))))},
    f"x AS kept, y AS made, CAST(length(x) + length(y) - 2 * {_LCS} AS INT) AS changes, y || chr(10) AS patched, '' AS same, CAST(NULL AS VARCHAR) AS bad")
pair("diff_text", {"u": lambda: diff.diff_lines_unified(F.concat("x", F.lit("\n"), "y", F.lit("\n")), F.concat("x", F.lit("\n!\n")), context=1, algorithm="patience")}, "'--- a' || chr(10) || '+++ b' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' ' || x || chr(10) || '-' || y || chr(10) || '+!' || chr(10) AS u")

_DIGITS = "translate(regexp_replace(upper({0}), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
# the first letter's own code counts, H and W are left out before runs are joined
_SOUNDEX = """(SELECT CASE WHEN l = '' THEN '' ELSE left(left(l, 1) || array_to_string(list_filter(list_slice(list_filter(string_split(d, ''), lambda c, i: i = 1 OR c <> string_split(d, '')[i - 1]), 2, 100), lambda c: c <> '0'), '') || '000', 4) END FROM (SELECT l, translate(left(l, 1) || regexp_replace(substr(l, 2), '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS d FROM (SELECT regexp_replace(upper({0}), '[^A-Z]', '', 'g') AS l)))"""
scalar("phonetic_soundex", "part", "p_partkey", {"s": lambda: phonetic.soundex(_c("p_name")), "none": lambda: phonetic.soundex(F.lit("123")), "same": lambda: phonetic.matches(_c("p_name"), F.upper("p_name")), "y": lambda: F.length(phonetic.nysiis(_c("p_name"))) <= 6}, f"{_SOUNDEX.format('p_name')} AS s, '' AS none, true AS same, true AS y")
scalar("phonetic_metaphone", "part", "p_partkey", {"one": lambda: F.concat_ws(",", phonetic.double_metaphone(F.lit("Schmidt"))["primary"], phonetic.double_metaphone(F.lit("Catherine"))["alternate"], phonetic.double_metaphone(F.lit("Xavier"))["alternate"], phonetic.double_metaphone(F.lit("Knight"))["primary"]), "both": lambda: phonetic.matches_double_metaphone(F.lit("Smith"), F.lit("Schmidt")), "primary": lambda: phonetic.matches_double_metaphone(F.lit("Smith"), F.lit("Schmidt"), primary_only=True), "sl": lambda: phonetic.slavic_metaphone(F.translate("p_name", "abegiklmnorstud", "абегиклмнорстуд")) == phonetic.slavic_metaphone(_c("p_name")), "praha": lambda: phonetic.slavic_metaphone(F.lit("Прага"))},
    "'XMT,KTRN,SFR,NT' AS one, true AS both, false AS \"primary\", true AS sl, 'PRH' AS praha")


@query("SELECT c_custkey AS l_id, s_suppkey AS r_id, regexp_extract(c_name, '[0-9]$') AS key FROM customer, supplier WHERE regexp_extract(c_name, '[0-9]$') = regexp_extract(s_name, '[0-9]$') AND c_custkey % 10 = 0 AND regexp_extract(c_name, '[0-9]$') <> ''")
def join_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join on a key, with a key that SQL has."""
    last = lambda c: F.regexp_extract(c, "[0-9]$", 0)
    c = read(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(_c("c_custkey").alias("id"), _c("c_name").alias("name"))
    s = read(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("id"), _c("s_name").alias("name"))
    return joins.phonetic_join(c, s, id_col="id", text_col="name", encoder=last)


@query("WITH q AS (SELECT c_custkey AS id, c_name || c_mktsegment AS t FROM customer), p AS (SELECT a.id AS query_id, b.id AS item_id, levenshtein(a.t, b.t) AS dist FROM q a, q b WHERE a.id % 100 = 0 AND a.id <> b.id) SELECT query_id, item_id, CAST(dist AS INT) AS dist, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id) AS r FROM p) WHERE r <= 3")
def nearest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(_c("c_custkey").alias("id"), F.concat("c_name", "c_mktsegment").alias("t"))
    return joins.nearest_texts(c.where("id % 100 = 0"), c, id_col="id", text_col="t", k=3)


@query("WITH g AS (SELECT s_suppkey AS id, unnest(list_distinct(list_transform(range(1, length(s_name) - 1), lambda i: substr(s_name, CAST(i AS INT), 3)))) AS g FROM supplier) SELECT a.id AS q_id, b.id AS i_id, count(*) AS shared FROM g a JOIN g b USING (g) WHERE a.id % 100 = 0 GROUP BY ALL HAVING count(*) >= 15")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("id"), grams.char_ngrams(_c("s_name"), 3).alias("g"))
    return joins.overlap_candidates(s.where("id % 100 = 0"), s, id_col="id", gram_col="g", least=15)


@query("SELECT p_partkey, CAST(16 AS INT) AS n64, CAST(8 AS INT) AS n128, true AS whole, CAST(0 AS BIGINT) AS same, true AS none FROM part")
def simhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", sketches.simhash_128_of(F.split("p_name", "")).alias("h"))
    p = p.select("p_partkey", "h", sketches.simhash_bands(_c("h.lo"), 16).alias("b"), sketches.simhash_bands_128(_c("h"), 8).alias("w"))
    back = F.aggregate(F.reverse("b"), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 4).bitwiseOR(x))
    empty = sketches.simhash_128(F.create_map().cast("map<string,bigint>"))
    return p.select("p_partkey", F.size("b").alias("n64"), F.size("w").alias("n128"), (back == _c("h.lo")).alias("whole"), sketches.simhash_hamming_128(_c("h"), _c("h")).cast("long").alias("same"), (empty["lo"] == 0).alias("none"))


@query("SELECT a.x AS \"left\", b.x AS \"right\", CAST(levenshtein(a.x, b.x) AS INT) AS d FROM (SELECT unnest(['', 'a', 'b', 'aa', 'ab', 'ba', 'bb']) AS x) a, (SELECT unnest(['', 'a', 'b', 'aa', 'ab', 'ba', 'bb']) AS x) b")
def exhaustive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.exhaustive_pairs(spark, "ab", 2).select("left", "right", F.levenshtein("left", "right").alias("d"))


@query("SELECT CAST(0 AS BIGINT) AS disagreements, CAST(2 AS BIGINT) AS known")
def differential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal kernels never disagree on the exhaustive pairs; two of the pairs tell OSA from Damerau."""
    pairs = registry.exhaustive_pairs(spark, "abc", 3)
    same = registry.differential_check(pairs, F.levenshtein("left", "right"), kernels.levenshtein_bytes(_c("left"), _c("right"))).agg(F.count(F.lit(1)).alias("disagreements"))
    known = registry.differential_check(pairs.where("left = 'ca' AND right = 'abc' OR left = 'abc' AND right = 'ca'"), kernels.osa("left", "right"), kernels.damerau("left", "right")).agg(F.count(F.lit(1)).alias("known"))
    return same.join(known, F.lit(True))


@query("SELECT true AS mass, true AS better, true AS identity")
def learned_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted to pairs of names that differ in their numbers holds a kept letter for likelier than another."""
    p = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s#"), F.right("s_name", F.lit(3))).alias("a"), F.concat(F.lit("s#"), F.lpad((_c("s_suppkey") + 1).cast("string"), 3, "0")).alias("b"))
    uniform, fitted = learned.LearnedModel.uniform("s#0123456789"), learned.train(p, source_col="a", target_col="b", alphabet="s#0123456789", rounds=3)
    return spark.createDataFrame([(abs(fitted.mass() - 1) < 1e-9, fitted.distance("s#001", "s#002") < uniform.distance("s#001", "s#002"), fitted.cost(("s", "s")) < fitted.cost(("s", "0")))], "mass boolean, better boolean, identity boolean")



_TURNS = "(SELECT a.conv_id, a.turn, regexp_replace(a.text, '[^\\x00-\\x7F]', '', 'g') AS x, regexp_replace(b.text, '[^\\x00-\\x7F]', '', 'g') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"


@query(f"SELECT conv_id, turn, CAST(levenshtein(x, y) AS INT) AS lev, round(CASE WHEN x = '' AND y = '' THEN 1.0 ELSE jaro_similarity(x, y) END, 9) AS jaro FROM {_TURNS}")
def dist_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each turn of a conversation to the next: pairs of whole texts, some hundred letters long."""
    plain = F.regexp_replace("text", "[^\\x00-\\x7F]", "")
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("t"))
    nxt = t.select("conv_id", (_c("turn") - 1).alias("turn"), _c("t").alias("y"))
    both = t.withColumnRenamed("t", "x").join(nxt, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.levenshtein("x", "y").alias("lev"), F.round(kernels.jaro_sim("x", "y"), 9).alias("jaro"))
