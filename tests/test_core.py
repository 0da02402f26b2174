import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import escapes, formats, grams, kernels, phonetic, strings
from loomtext.operators import chunking, diff, joins


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_published_values():
    assert kernels.osa_distance("ca", "abc") == 3 and kernels.damerau_distance("ca", "abc") == 2
    assert kernels.jaro("", "") == 1.0 and kernels.jaro("", "a") == 0.0
    assert kernels.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert kernels.lcs_length("ABCBDAB", "BDCABA") == 4
    assert phonetic.nysiis_key("") == ""


def test_strings(spark):
    lit = F.lit
    assert value(spark, strings.find(lit("hello"), "l")) == 2 and value(spark, strings.rfind(lit("hello"), "l")) == 3
    assert value(spark, strings.find(lit("x"), "y")) is None
    assert value(spark, strings.find_all(lit("aXbXc"), "X")) == [1, 3]
    assert value(spark, strings.find_overlapping(lit("aaa"), "aa")) == [0, 1]
    assert value(spark, strings.slugify(lit("Hello, World!"))) == "hello-world"
    assert value(spark, strings.title_case(lit("foo-bar baz"))) == "Foo-Bar Baz"
    assert value(spark, strings.pad_left(lit("hello"), 3)) == "hello" and value(spark, strings.center(lit("ab"), 5, "*")) == "*ab**"
    assert value(spark, strings.to_case(lit("someHTTPName"), "snake")) == "some_http_name"
    assert value(spark, strings.replace_last(lit("a-b-c"), "-", "+")) == "a-b+c"
    assert value(spark, strings.split_lines(lit("a\r\nb\n"))) == ["a", "b"]
    assert value(spark, escapes.unescape_html(strings.escape_html(lit("<a&'b'>")))) == "<a&'b'>"
    assert value(spark, strings.escape_json(lit('a"\n'))) == '\\"'.join(["a", ""]) + "\\n"
    assert value(spark, strings.classify_script(lit("Привет мир"))) == "Cyrl" and value(spark, strings.classify_script(lit("12"))) is None


def test_grams(spark):
    two = lambda t: grams.char_ngrams(F.lit(t), 2)
    assert value(spark, grams.jaccard(two("night"), two("nacht"))) == pytest.approx(1 / 7)
    assert value(spark, grams.char_ngrams(F.lit("hi"), 5)) == []
    assert value(spark, grams.entropy(F.lit("abababab"))) == 1.0
    assert value(spark, grams.hamming(F.lit("karolin"), F.lit("kathrin"))) == 3
    assert [value(spark, phonetic.soundex(F.lit(n))) for n in ("Robert", "Tymczak", "Pfister", "12")] == ["R163", "T522", "P236", ""]
    picks = value(spark, grams.winnow(F.array(*map(F.lit, (77, 74, 42, 17, 98, 50, 17, 98, 8, 88, 67, 39, 77, 74, 42, 17, 98))), 4))
    assert [(p.position, p.hash) for p in picks] == [(3, 17), (6, 17), (8, 8), (11, 39), (15, 17)]
    assert value(spark, formats.plural_cardinal(F.lit(22), "ru")) == "few"


def test_joins_against_all_pairs(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for k in (1, 2):
        got = {(x.l_id, x.r_id) for x in joins.edit_join(frame, frame, id_col="id", text_col="t", distance=k).collect()}
        pairs = frame.alias("a").join(frame.alias("b"), F.levenshtein("a.t", "b.t") <= k).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        assert got == {(x.a, x.b) for x in pairs.collect()}
    sets = frame.select("id", grams.char_ngrams(F.col("t"), 2).alias("g"))
    got = {(x.l_id, x.r_id) for x in joins.jaccard_join(sets, sets, id_col="id", gram_col="g", threshold=0.5).collect()}
    rows = {x.id: set(x.g) for x in sets.collect()}
    assert got == {(a, b) for a in rows for b in rows if rows[a] and rows[b] and len(rows[a] & rows[b]) / len(rows[a] | rows[b]) >= 0.5}


def test_diff_and_chunks():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randrange(12))] for _ in range(2))
        script = diff.myers(a, b)
        assert [v for o, v in script if o != "insert"] == a and [v for o, v in script if o != "delete"] == b
        assert sum(o != "keep" for o, _ in script) == len(a) + len(b) - 2 * kernels.lcs_length("".join(a), "".join(b))
        x, y = ("".join(v + "\n" for v in s) for s in (a, b))
        assert diff.apply_unified(x, diff.unified(x, y)) == y
    data = bytes(r.randrange(256) for _ in range(40000))
    ends = chunking.cut_points(data, chunking.Cdc.around(256, 1024, 4096))
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and max(sizes) <= 4096 and min(sizes[:-1]) >= 256
    assert all(len(p) <= 20 for p in chunking.split_recursive("word " * 40, 20))


def test_stream_search(spark, tmp_path):
    from loomtext.streaming.search import search_stream

    spark.createDataFrame([("k", i, p) for i, p in enumerate(["ab", "cab", "c"])], "key string, seq long, piece string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, seq long, piece string").parquet(f"{tmp_path}/in")
    q = search_stream(stream, ["abc", "ca"]).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((x.position, x.pattern_index) for x in spark.sql("select * from found").collect()) == [(0, 0), (2, 1), (3, 0)]
