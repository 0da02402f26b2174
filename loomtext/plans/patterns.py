"""Queries of searching and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import patterns, strings
from loomtext.plans.base import scalar

_c = F.col
_many = patterns.MultiPattern(["ring", "in", "e", "small"])


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


scalar("search_all", "customer", "c_custkey", {"at": lambda: _joined(strings.find_all(_c("c_name"), "0")), "ends": lambda: F.size(strings.find_all(_c("c_name"), "")), "n": lambda: strings.count_matches(_c("c_name"), ""), "any": lambda: strings.find_any(_c("c_name"), ["9", "5", "0"])["at"], "which": lambda: strings.find_any(_c("c_name"), ["9", "5", "0"])["needle"], "byte": lambda: strings.byte_offset(F.concat(F.lit("é"), "c_name"), strings.find(F.concat(F.lit("é"), "c_name"), "#"))},
    "array_to_string(list_filter(range(0, length(c_name)), lambda i: substr(c_name, CAST(i + 1 AS INT), 1) = '0'), '|') AS at, CAST(length(c_name) + 1 AS INT) AS ends, CAST(length(c_name) + 1 AS INT) AS n, CAST(CASE WHEN regexp_matches(c_name, '[950]') THEN length(regexp_extract(c_name, '^[^950]*')) END AS INT) AS any, CAST(CASE regexp_extract(c_name, '[950]') WHEN '9' THEN 0 WHEN '5' THEN 1 WHEN '0' THEN 2 END AS INT) AS which, CAST(10 AS INT) AS byte")
scalar("search_many", "part", "p_partkey", {"hits": lambda: _joined(F.transform(_many.find_all(_c("p_name")), lambda m: F.concat(m["position"].cast("string"), F.lit(":"), m["pattern_index"].cast("string")))), "any": lambda: _many.is_match(_c("p_name"))},
    "array_to_string(list_transform(list_sort(flatten(list_transform([{'p': 'ring', 'k': 0}, {'p': 'in', 'k': 1}, {'p': 'e', 'k': 2}, {'p': 'small', 'k': 3}], lambda q: list_transform(list_filter(range(0, length(p_name)), lambda i: substr(p_name, CAST(i + 1 AS INT), length(q.p)) = q.p), lambda i: {'i': i, 'k': q.k})))), lambda m: m.i || ':' || m.k), '|') AS hits, regexp_matches(p_name, 'ring|in|e|small') AS any")
scalar("pattern_glob", "customer", "c_custkey", {"whole": lambda: patterns.glob("Customer#0000*[1-4]?").is_match(_c("c_name")), "not_": lambda: patterns.glob("*[!0-5]").is_match(_c("c_name")), "some": lambda: patterns.glob("#0*[79]", anywhere=True).is_match(_c("c_name")), "wild": lambda: patterns.wildcard("0?1", anywhere=True).is_match(_c("c_name")), "lit": lambda: patterns.literal("#000").is_match(_c("c_name")), "line": lambda: patterns.wildcard("Cust*1").is_match(F.concat(F.lit("Cust1"), F.lit("\n")))},
    "regexp_full_match(c_name, 'Customer#0000.*[1-4].') AS whole, regexp_full_match(c_name, '.*[^0-5]') AS not_, regexp_matches(c_name, '#0.*[79]') AS some, regexp_matches(c_name, '0.1') AS wild, contains(c_name, '#000') AS lit, false AS line")
scalar("pattern_operations", "part", "p_partkey", {"first": lambda: patterns.regex("[aeiou]+").find(_c("p_name"))["text"], "start": lambda: patterns.regex("[aeiou]+").find(_c("p_name"))["start"], "every": lambda: _joined(patterns.regex("[aeiou]+").find_iter(_c("p_name"))), "spans": lambda: _joined(F.transform(patterns.regex("[aeiou]+").find_spans(_c("p_name")), lambda m: m["end"])), "put": lambda: patterns.regex("[aeiou]+").replace_all(_c("p_name"), "$1\\"), "cut": lambda: _joined(patterns.regex("[aeiou]+").split(_c("p_name")))},
    r"nullif(regexp_extract(p_name, '[aeiou]+'), '') AS first, CAST(CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^[^aeiou]*')) END AS INT) AS start, array_to_string(regexp_extract_all(p_name, '[aeiou]+'), '|') AS every, array_to_string(list_filter(range(1, length(p_name) + 1), lambda i: regexp_matches(substr(p_name, CAST(i AS INT), 1), '[aeiou]') AND NOT regexp_matches(substr(p_name, CAST(i + 1 AS INT), 1), '[aeiou]')), '|') AS spans, regexp_replace(p_name, '[aeiou]+', '$1\\', 'g') AS put, array_to_string(string_split_regex(p_name, '[aeiou]+'), '|') AS cut")
scalar("pattern_regex", "documents", "doc_id", {"words": lambda: F.size(patterns.regex(r"\w+").find_iter(_c("text"))), "ascii": lambda: F.size(patterns.regex(r"\w+", bytes_only=True).find_iter(_c("text"))), "the": lambda: patterns.regex(r"\bTHE\b", ignore_case=True).is_match(_c("text")), "plain": lambda: patterns.literal("a.b").is_match(_c("text"))},
    r"CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_\x{200c}\x{200d}]+')) AS INT) AS words, CAST(len(regexp_extract_all(text, '\w+')) AS INT) AS ascii, regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])the($|[^\p{L}\p{M}\p{N}_])') AS the, contains(text, 'a.b') AS plain")
