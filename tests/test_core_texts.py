import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions import batches, detection, escapes, grams, patterns, segments, strings, tokenizers, transliteration, wrapping
from loomtext.languages import packs, stemmers


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


T = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """The text column; a Column needs a session."""
    global T
    T = F.col("t")


def test_anchored_patterns_see_a_last_line_feed(spark):
    assert values(spark, ["ls\n", "ls", "", None, "a b"], strings.shell_quote(T)) == ["'ls\n'", "ls", "''", None, "'a b'"]
    assert values(spark, ["Cust1\n", "Cust1", "Cust12"], strings.wildcard(T, "Cust?")) == [False, True, False]


def test_bytes_and_boundaries(spark):
    texts = ["aé中😀z", "", None, "abc"]
    for n in range(0, 12):
        want = [None if t is None else t.encode()[:n].decode(errors="ignore") for t in texts]
        got = values(spark, texts, strings.take_bytes(T, n), strings.drop_bytes(T, n))
        assert [g for g, _ in got] == want
        assert [None if g is None else g + d for g, d in got] == texts
    assert values(spark, texts, strings.slice_bytes(T, 1, 3)) == ["é", None, None, "bc"]
    assert values(spark, texts, strings.slice_bytes(T, 2, 3)) == [None, None, None, "c"]


def test_find_all_is_linear(spark):
    began = time.time()
    assert values(spark, ["ab" * 100_000, None, ""], F.size(strings.find_all(T, "ab"))) == [100_000, None, 0]
    assert time.time() - began < 10
    assert values(spark, ["aaaa"], strings.find_all(T, "aa")) == [[0, 2]]


def test_replace_many_is_one_pass(spark):
    pairs = [("a", "b"), ("b", "a"), ("abc", "!"), ("", "x"), ("c$", "\\E")]
    assert values(spark, ["abcab", "c$1", "", None], strings.replace_many(T, pairs)) == ["bacba", "\\E1", "", None]


def test_lines(spark):
    texts = ["a\n\n  b\r\nc", "", "x\n", None, "\n", "\tq\n\t  r\n \t\n"]
    rows = values(spark, texts, strings.prefix_lines(T, "> "), strings.suffix_lines(T, ";"), strings.indent(T, 2), strings.trim_lines(T), strings.dedent(T))
    assert rows[0] == ("> a\n> \n>   b\r\n> c", "a;\n;\n  b;\r\nc;", "  a\n\n    b\r\n  c", "a\n\nb\r\nc", "a\n\n  b\r\nc")
    assert rows[1][:4] == ("", "", "", "") and rows[2][:2] == ("> x\n", "x;\n") and rows[3] == (None,) * 5
    assert rows[5][4] == "q\n  r\n\n"


def test_quotes(spark):
    texts = ["hello", 'say "hi"', "it's \"good\"", "\"'`", None, ""]
    assert values(spark, texts, strings.quote_smart(T)) == ['"hello"', "'say \"hi\"'", "`it's \"good\"`", "\"\\\"'`\"", None, '""']
    assert values(spark, ["a<b>c", "[a]"], strings.angle_quote(T), strings.custom_quote(T, "[", "]", "%")) == [("<a\\<b\\>c>", "[a<b>c]"), ("<[a]>", "[%[a%]]")]


def test_escapes_against_python(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(['"', "\\", "\n", "\t", "é", "中", "a", " ", "/", "<", "&", "'", "\x01", "%", "😀"]) for _ in range(r.randrange(12))) for _ in range(60)] + ["", None]
    rows = values(spark, texts, escapes.unescape_json(strings.escape_json(T)), escapes.unescape_c_string(escapes.c_string(T)), escapes.unescape_html(escapes.html_text(T)), escapes.shell_unquote(strings.shell_quote(T)))
    assert all(x == t for t, row in zip(texts, rows, strict=True) for x in row)
    entities = ["&eacute;&#233;&#xE9;&nosuch;&lt", "&amp;lt;", "&;&#;"]
    assert values(spark, entities, escapes.unescape_html(T)) == [re.sub("&(#[0-9]+|#x[0-9A-Fa-f]+|[a-zA-Z]+);", lambda m: html.unescape(m[0]), e) for e in entities]
    assert values(spark, ["hello", 'a"b', "path\\", "a b", ""], escapes.shell_windows(T)) == ["hello", '"a\\"b"', '"path\\\\"', '"a b"', '""']
    assert values(spark, ["\\101\\x41\\u00E9", "\\", "\\xff", "\\U00110000"], escapes.unescape_c_string(T)) == ["AAé", None, None, None]
    long = '\\n"' * 50_000
    assert values(spark, ["\\n" * 100_000, long], F.length(escapes.unescape_json(T))) == [100_000, None]


def test_globs(spark):
    texts = ["report-1.txt", "report-x.txt", "a[b", "a*c", "", "]"]
    matches = lambda p, **k: [t for t, hit in zip(texts, values(spark, texts, patterns.glob(p, **k).is_match(T)), strict=True) if hit]
    assert matches("report-[0-9].txt") == ["report-1.txt"]
    assert matches("report-[!0-9].*") == ["report-x.txt"]
    assert matches("a\\[b") == ["a[b"] and matches("a\\*c") == ["a*c"] and matches("[]]") == ["]"] and matches("") == [""]
    assert matches("t-?", anywhere=True) == ["report-1.txt", "report-x.txt"]
    with pytest.raises(ValueError):
        patterns.regex("(?=a)b")
    with pytest.raises(ValueError):
        patterns.regex("(a")


def test_multi_pattern_by_brute_force():
    r = random.Random(9)
    for _ in range(100):
        many = ["".join(r.choice("ab") for _ in range(r.randrange(4))) for _ in range(5)]
        text = "".join(r.choice("ab") for _ in range(20))
        want = sorted((i, k) for k, p in enumerate(many) for i in range(len(text)) if (p and text.startswith(p, i)) or (not p and i == 0))
        assert patterns.MultiPattern(many).places(text) == want


def test_segmentation_rules():
    assert segments.word_list("The quick (\"brown\") fox can't jump 32.3 feet, right?") == ["The", "quick", "brown", "fox", "can't", "jump", "32.3", "feet", "right"]
    assert segments.sentence_list("Mr. Who went. (Yes.) \"No.\" said he. 3.5 is e.g. fine...\nNew") == ["Mr. ", "Who went. ", "(Yes.) ", '"No." said he. ', "3.5 is e.g. fine...\n", "New"]
    cut = segments._cut
    assert cut("foo-bar (baz) 3,5% $1.00 a/b\nc") == ["foo-", "bar ", "(baz) ", "3,5% ", "$1.00 ", "a/", "b\n", "c"]
    assert cut("中文。字") == ["中", "文。", "字"] and cut("") == []
    for text in ("á b", " x", "x  ", "\r\n\r\n", "👍🏽👍", "🇫🇷🇩🇪x"):
        assert "".join(cut(text)) == text and "".join(segments.sentence_list(text)) == text and "".join(segments.word_bound_list(text)) == text


def test_wrapping():
    text = "The quick brown fox jumps over the lazy dog and supercalifragilistic"
    lines = wrapping.wrapped(text, 12)
    assert max(map(len, lines)) <= 12 and "".join(lines).replace(" ", "") == text.replace(" ", "")
    assert wrapping.wrapped(text, 12, break_words=False)[-1] == "supercalifragilistic"
    assert wrapping.wrapped("", 5) == [""] and wrapping.wrapped("a\n\nb", 5) == ["a", "", "b"] and wrapping.wrapped("aaa bbb ccc", 7, True, "* ", "  ") == ["* aaa", "  bbb", "  ccc"]


def test_stemmers_on_published_words():
    english = "consist consist consisted consist consistency consist knackeries knackeri running run hopping hop hoping hope relational relat happy happi skies sky dying die agreed agre national nation generously generous organization organiz".split()
    assert [stemmers.porter2(w) for w in english[::2]] == english[1::2]
    assert [stemmers.porter(w) for w in ("caresses", "ponies", "relational", "hopping", "generalizations", "oscillators")] == ["caress", "poni", "relat", "hop", "gener", "oscil"]
    for stem, pairs in ((stemmers.german, "aufeinanderfolge aufeinanderfolg häuser haus kategorischen kategor bildnissen bildnis"), (stemmers.french, "continuellement continuel majestueusement majestu maintenant mainten"), (stemmers.russian, "вагонами вагон важнейшие важн валились вал"), (stemmers.dutch, "lichamelijkheden licham opgenomen opgenom"), (stemmers.spanish, "torearon tor tolerancia toler"), (stemmers.italian, "abbandonerà abbandon pronunciamento pronunc"), (stemmers.portuguese, "quimioterapia quimioterap química químic"), (stemmers.swedish, "jaktkarlarne jaktkarl klokheten klok"), (stemmers.norwegian, "havnedistriktene havnedistrikt oppdragelsen oppdrag"), (stemmers.danish, "undersøgelsen undersøg indtages indtag")):
        found = pairs.split()
        assert [stem(w) for w in found[::2]] == found[1::2]
    for stem in stemmers.STEMMERS.values():
        for word in ("", "a", "ss", "ы", "é", "x" * 500):
            assert isinstance(stem(word), str)


def test_packs(spark):
    assert packs.language("pt-BR-x-y").code == "pt" and packs.language("xx") is None and packs.language_exact("EN").name == "English"
    with pytest.raises(ValueError):
        packs.stop_words("cs")
    assert packs.with_stop_words("cs", ["a", "i"]).stop_words == ("a", "i") and "der" in packs.stop_words("de")
    assert values(spark, ["The", "cat", None], packs.is_stop_word(T, "en")) == [True, False, None]
    assert values(spark, ["the cats ran", None], packs.stem_all(packs.tokenize(T, "en"), "en")) == [["the", "cat", "ran"], None]


def test_detection(spark):
    texts = ["this is the way that it was", "il gatto è con la mia casa", "Это было", "これは", "", None, "zzz"]
    got = values(spark, texts, detection.detect(T, ["en", "it"])["language"])
    assert got == ["en", "it", None, "ja", None, None, None]
    assert values(spark, texts[:1], detection.detect_from(T, ["xx"])["language"]) == [None]


def test_tokenizers(spark):
    word = tokenizers.word_level({"[UNK]": 0, "a": 1, "b": 2})
    assert values(spark, ["a b c", "", None], word.ids(T), word.encode(T)["ends"]) == [([1, 2, 0], [1, 3, 5]), ([], []), (None, None)]
    piece = tokenizers.word_piece({"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3}, longest=12)
    assert values(spark, ["unaffable", "unaffablex", "un" * 10], piece.ids(T)) == [[1, 2, 3], [0], [0]]
    assert values(spark, ["x"], piece.decode(F.array(F.lit(1), F.lit(2), F.lit(3)))) == ["unaffable"]
    uni = tokenizers.unigram([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -1.5)])
    assert values(spark, ["abab", "aab"], uni.encode(T)["tokens"]) == [["ab", "ab"], ["a", "ab"]]
    with pytest.raises(ValueError):
        tokenizers.Tokenizer.from_json("{}")
    with pytest.raises(ValueError):
        tokenizers.load_json("not json")
    old = tokenizers.load_json('{"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}')
    assert old["model"]["type"] == "BPE" and old["model"]["merges"] == [["a", "b"]]
    pair = word.encode_pair(T, F.lit("b b b"), most=4)
    assert values(spark, ["a a a a a"], pair["ids"]) == [[1, 1, 2, 2]]


def test_pad_batch_is_over_the_whole_group(spark):
    df = spark.createDataFrame([("x", [1]), ("x", [1, 2, 3]), ("y", [5, 6])], "g string, ids array<int>").repartition(3)
    got = {tuple(r.ids): r.attention for r in tokenizers.pad_batch(df, "ids", token=9, group_col="g").collect()}
    assert got == {(1, 9, 9): [1, 0, 0], (1, 2, 3): [1, 1, 1], (5, 6): [1, 1]}
    assert sorted(r.ids for r in tokenizers.pad_batch(df, "ids", side="left").collect()) == [[0, 0, 1], [0, 5, 6], [1, 2, 3]]


def test_transliteration(spark):
    assert values(spark, ["Žluťoučký", "Чехов", "Ωμέγα", "ß", None], transliteration.to_ascii(T)) == ["Zlutoucky", "Chekhov", "Omega", "ss", None]
    assert values(spark, ["Љубав Његош џеп"], transliteration.serbian_to_latin(T)) == ["Ljubav Njegoš džep"]


def test_ngrams_padded(spark):
    assert values(spark, ["hi", "", None], grams.byte_ngrams(T, 2, pad=True)) == [["0068", "6869", "6900"], ["0000"], None]
    assert values(spark, ["é"], grams.byte_ngrams(T, 1)) == [["c3", "a9"]]
    assert batches.text_udf is not None
