"""Queries of language packs, detection, formats and tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import detection, formats, tokenizers
from loomtext.languages import packs
from loomtext.plans.base import query, read, scalar

_c = F.col


@query("SELECT * FROM (VALUES ('en', 'English', 'Latn'), ('zh', 'Chinese', 'Hans'), ('am', 'Amharic', 'Ethi')) t(code, name, script)")
def language_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.languages(spark).where("code IN ('en', 'zh', 'am')").select("code", "name", "script")


_STOP = "', '".join(w.replace("'", "''") for w in packs.stop_words("en"))
scalar("stop_words", "part", "p_partkey", {"the": lambda: packs.is_stop_word(F.lit("The"), "en"), "word": lambda: packs.is_stop_word(F.split_part("p_name", F.lit(" "), F.lit(1)), "en-GB"), "left": lambda: F.array_join(packs.remove_stop_words(packs.tokenize(F.concat(F.lit("the "), "p_name", F.lit(" of it")), "en"), "en"), " ")}, f"true AS the, split_part(p_name, ' ', 1) IN ('{_STOP}') AS word, array_to_string(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('{_STOP}')), ' ') AS left")
scalar("stop_word_share", "documents", "doc_id", {"n": lambda: F.size(F.filter(packs.tokenize(F.regexp_replace("text", "[^A-Za-z ]", " "), "en"), lambda w: packs.is_stop_word(w, "en")))}, f"CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ('{_STOP}'))) AS INT) AS n")
scalar("stems", "part", "p_partkey", {"en": lambda: packs.stem(F.lit("conditional"), "en"), "de": lambda: packs.stem(F.lit("häuser"), "de-AT"), "fr": lambda: packs.stem(F.lit("continuellement"), "fr"), "ru": lambda: packs.stem(F.lit("вагонами"), "ru"), "row": lambda: packs.stem_by_language(F.lit("running"), F.lit("en")), "none": lambda: packs.stem(_c("p_name"), "vi"), "all_": lambda: F.array_join(packs.stem_all(F.split(F.lit("running flies"), " "), "en"), " "), "split": lambda: F.array_join(packs.english_tokens(F.lit("I can't, we'll")), "|")}, "'condit' AS en, 'haus' AS de, 'continuel' AS fr, 'вагон' AS ru, 'run' AS \"row\", p_name AS \"none\", 'run fli' AS all_, 'I|ca|n''t|we|''ll' AS split")
scalar("detect_languages", "part", "p_partkey", {"en": lambda: detection.detect(F.concat(F.lit("this is the way to "), "p_name"))["language"], "it": lambda: detection.detect_words(F.lit("il gatto e la casa di una"), ["it", "en"])["language"], "none": lambda: detection.detect_words(F.lit("zzz qqq"))["language"], "only": lambda: detection.detect_from(F.lit("the way"), ["xx"])["language"], "ja": lambda: detection.detect(F.lit("これは日本語"))["language"], "first": lambda: F.get(detection.detect_ranked(F.lit("il la lo di una"), ["it", "en"]), F.lit(0))["language"], "share": lambda: detection.confidence_of(F.lit("il gatto"), "it")}, "'en' AS en, 'it' AS it, CAST(NULL AS VARCHAR) AS \"none\", CAST(NULL AS VARCHAR) AS only, 'ja' AS ja, 'it' AS first, 0.5::DOUBLE AS share")
scalar("parse_iso", "orders", "o_orderkey", {"d": lambda: formats.parse_iso_date(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("string"), "bad": lambda: formats.parse_iso_date(F.lit("2024-2-30")).cast("string"), "t": lambda: formats.parse_iso_time(F.lit("17:03:04")), "no": lambda: formats.parse_iso_time(F.lit("25:00:00")), "both": lambda: formats.parse_iso_datetime(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")) == _c("o_orderdate")}, "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS bad, CAST(61384 AS INT) AS t, CAST(NULL AS INT) AS no, true AS both")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%b ') || day(o_orderdate) || ', ' || year(o_orderdate) AS en, day(o_orderdate) || '. ' || ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'][month(o_orderdate)] || ' ' || year(o_orderdate) AS de, '17:03' AS t,
['lundi', 'mardi', 'mercredi', 'jeudi', 'vendredi', 'samedi', 'dimanche'][isodow(o_orderdate)] || ' ' || day(o_orderdate) || ' ' || ['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'][month(o_orderdate)] || ' ' || year(o_orderdate) AS fr, strftime(o_orderdate, '%d.%m.%Y') || ', 00:00:00' AS both FROM orders""")
def format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _c("o_orderdate").cast("date")
    both = formats.format_datetime(spark, _c("o_orderdate"), "de", "medium")
    return read(spark, sf_dir, "orders").select("o_orderkey", formats.format_date(spark, d, "en").alias("en"), formats.format_date(spark, d, "de", "long").alias("de"), formats.format_time(spark, F.lit("17:03:04"), "de", "short").alias("t"), formats.format_date(spark, d, "fr", "full").alias("fr"), both.alias("both"))


@query("SELECT o_orderkey, regexp_replace(regexp_replace(format('{:,.2f}', o_totalprice), '0+$', ''), '\\.$', '') AS en, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS de, '12,34,567.5' AS hi, CAST(NULL AS VARCHAR) AS none FROM orders")
def format_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = _c("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", formats.format_number(spark, price, "en", 0, 2).alias("en"), formats.format_number(spark, price, "de", 2, 2).alias("de"), formats.format_number(spark, F.lit(1234567.5), "en-IN").alias("hi"), formats.format_number(spark, F.lit(float("nan"))).alias("none"))


scalar("format_money", "orders", "o_orderkey", {"c": lambda: formats.format_currency(-_c("o_totalprice"), "€", 2, "de"), "p": lambda: formats.format_percent(F.lit(0.256), 1, "en"), "b": lambda: formats.bounded(_c("o_totalprice") / 1e12) == _c("o_totalprice") / 1e12, "out": lambda: formats.bounded(F.lit(1.5))}, "'-' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') || ' €' AS c, '25.6%' AS p, true AS b, CAST(NULL AS DOUBLE) AS out")
scalar("plural_categories", "lineitem", "l_orderkey", {"en": lambda: formats.plural_cardinal(_c("l_linenumber") * 0.5, "en"), "pl": lambda: formats.plural_cardinal(_c("l_quantity"), "pl-PL"), "ar": lambda: formats.plural_cardinal(_c("l_linenumber") - 1, "ar"), "fr": lambda: formats.plural_cardinal(_c("l_linenumber") * 0.5, "fr"), "it": lambda: formats.plural_ordinal(_c("l_linenumber") + 4, "it"), "v": lambda: formats.plural_operands(_c("l_linenumber") * 0.25)["v"], "f": lambda: formats.plural_operands(_c("l_linenumber") * 0.25)["f"], "xx": lambda: formats.plural_cardinal(_c("l_linenumber"), "xx")},
    "CASE WHEN l_linenumber = 2 THEN 'one' ELSE 'other' END AS en, CASE WHEN l_quantity = 1 THEN 'one' WHEN l_quantity % 10 BETWEEN 2 AND 4 AND l_quantity % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS pl, CASE l_linenumber WHEN 1 THEN 'zero' WHEN 2 THEN 'one' WHEN 3 THEN 'two' ELSE 'few' END AS ar, CASE WHEN l_linenumber < 4 THEN 'one' ELSE 'other' END AS fr, CASE WHEN l_linenumber IN (4, 7) THEN 'many' ELSE 'other' END AS it, CAST(CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INT) AS v, CAST(CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 5 ELSE 75 END AS BIGINT) AS f, 'other' AS xx")

_WORDS = {"[UNK]": 0, "small": 1, "red": 2, "ring": 3, "widget": 4}
_CASES = "list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'small' THEN 1 WHEN 'red' THEN 2 WHEN 'ring' THEN 3 WHEN 'widget' THEN 4 ELSE 0 END)"
_LETTERS = "abcdefghijklmnopqrstuvwxyz "


def _word_level() -> tokenizers.Tokenizer:
    return tokenizers.word_level(_WORDS)


def _word_piece() -> tokenizers.Tokenizer:
    return tokenizers.word_piece({"[UNK]": 0, **{ch: i for i, ch in enumerate(_LETTERS, 1)}, **{f"##{ch}": 100 + i for i, ch in enumerate(_LETTERS, 1)}, "small": 200})


def _letters_bpe() -> tokenizers.Tokenizer:
    return tokenizers.bpe({**{ch: i for i, ch in enumerate(_LETTERS)}, "in": 50, "ing": 51}, [("i", "n"), ("in", "g")])


def _letters_unigram() -> tokenizers.Tokenizer:
    return tokenizers.unigram([("<unk>", 0.0), *((ch, -3.0) for ch in _LETTERS), ("ing", -4.0)])


def _bert() -> tokenizers.Tokenizer:
    words = {"[UNK]": 0, "[CLS]": 10, "[SEP]": 11, "small": 1, "ring": 3}
    parts = {"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": {"type": "BertProcessing", "sep": ["[SEP]", 11], "cls": ["[CLS]", 10]}}
    return tokenizers.with_parts({"type": "WordLevel", "vocab": words, "unk_token": "[UNK]"}, **parts)


scalar("tokenize_words", "part", "p_partkey", {"ids": lambda: F.array_join(_word_level().ids(_c("p_name")), ","), "n": lambda: _word_level().count(_c("p_name")), "back": lambda: _word_level().decode(F.array(F.lit(1), F.lit(3))), "none": lambda: _word_level().decode(F.array(F.lit(999))), "starts": lambda: F.array_join(_word_level().encode(_c("p_name"))["starts"], ",")}, f"array_to_string({_CASES}, ',') AS ids, CAST(len(string_split(p_name, ' ')) AS INT) AS n, 'small ring' AS back, CAST(NULL AS VARCHAR) AS \"none\", CASE WHEN contains(p_name, ' ') THEN '0,' || instr(p_name, ' ') ELSE '0' END AS starts")
scalar("tokenize_pieces", "part", "p_partkey", {"n": lambda: _word_piece().count(_c("p_name")), "back": lambda: _word_piece().join_tokens(F.array(F.lit("s"), F.lit("##o"))), "bpe": lambda: F.array_join(_letters_bpe().encode(_c("p_name"))["tokens"], "|"), "uni": lambda: F.array_join(_letters_unigram().encode(_c("p_name"))["tokens"], "|"), "whole": lambda: _letters_unigram().decode(_letters_unigram().ids(_c("p_name")))},
    "CAST(list_sum(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN prefix(w, 'small') THEN length(w) - 4 ELSE length(w) END)) AS INT) AS n, 'so' AS back, array_to_string(regexp_extract_all(p_name, 'ing|in|.'), '|') AS bpe, array_to_string(regexp_extract_all(p_name, 'ing|.'), '|') AS uni, array_to_string(regexp_extract_all(p_name, 'ing|.'), ' ') AS whole")
scalar("tokenize_special", "part", "p_partkey", {"ids": lambda: F.array_join(_bert().ids(F.upper("p_name")), ","), "bare": lambda: F.array_join(_bert().ids(F.upper("p_name"), add_special=False), ","), "mask": lambda: F.array_join(_bert().encode(_c("p_name"))["special"], ""), "types": lambda: F.array_join(_bert().encode_pair(_c("p_name"), F.lit("ring"))["type_ids"], ""), "cut": lambda: F.array_join(_bert().encode(_c("p_name"), most=2)["ids"], ","), "pair": lambda: F.size(_bert().encode_pair(F.lit("ring ring ring"), F.lit("small"), most=2)["ids"]), "low": lambda: _bert().normalize(F.upper("p_name")), "pre": lambda: F.size(_bert().pre_tokenize(_c("p_name")))},
    "'10,' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'small' THEN 1 WHEN 'ring' THEN 3 ELSE 0 END), ',') || ',11' AS ids, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'small' THEN 1 WHEN 'ring' THEN 3 ELSE 0 END), ',') AS bare, '1' || repeat('0', len(string_split(p_name, ' '))) || '1' AS mask, repeat('0', len(string_split(p_name, ' ')) + 2) || '11' AS types, '10,' || CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 1 WHEN 'ring' THEN 3 ELSE 0 END AS cut, CAST(5 AS INT) AS pair, p_name AS low, CAST(len(string_split(p_name, ' ')) AS INT) AS pre")
scalar("byte_alphabet", "part", "p_partkey", {"e": lambda: tokenizers.byte_level_encode(_c("p_name")), "back": lambda: tokenizers.byte_level_decode(tokenizers.byte_level_encode(F.concat("p_name", F.lit("é中\x00"))))}, "replace(p_name, ' ', 'Ġ') AS e, p_name || 'é中' || chr(0) AS back")


@query("SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: length(w))::INT[] || list_transform(range(0, (SELECT max(len(string_split(p_name, ' '))) FROM part) - len(string_split(p_name, ' '))), lambda i: 0)::INT[] AS ids FROM part")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.transform(F.split("p_name", " "), F.length).alias("ids"))
    return tokenizers.pad_batch(p, "ids").select("p_partkey", "ids")


def _ranks() -> tokenizers.RankTokenizer:
    return tokenizers.RankTokenizer({bytes([b]): b for b in range(256)} | {b"in": 256, b"ing": 257}, r"\S+|\s+", {"<|end|>": 300})


scalar("tokenize_ranks", "part", "p_partkey", {"n": lambda: F.size(_ranks().encode(_c("p_name"))), "back": lambda: _ranks().decode(_ranks().encode(_c("p_name"))), "bad": lambda: _ranks().encode(F.concat("p_name", F.lit("<|end|>"))).isNull(), "end": lambda: F.element_at(_ranks().encode(F.concat("p_name", F.lit("<|end|>")), allowed="all"), -1), "text": lambda: F.size(_ranks().encode(F.lit("<|end|>"), disallowed=set()))}, "CAST(len(regexp_extract_all(p_name, 'ing|in|.')) AS INT) AS n, p_name AS back, true AS bad, CAST(300 AS INT) AS \"end\", CAST(7 AS INT) AS text")
