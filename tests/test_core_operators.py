import random

import pytest
from pyspark.sql import functions as F

from loomtext import registry
from loomtext.functions import batch_kernels, formats, kernels, learned, phonetic, rolling, sketches
from loomtext.operators import chunking, components, diff, joins

M64 = (1 << 64) - 1


def plain_cuts(data, cdc):
    """One byte at a time: bytes below the least aren't hashed."""
    ends, h, n = [], 0, 0
    table = [int(x) for x in rolling.GEAR]
    for i, b in enumerate(data):
        n += 1
        if n < cdc.least:
            continue
        h = ((h << 1) + table[b]) & M64
        if n >= cdc.most or h & (cdc.strict if n <= cdc.average else cdc.loose) == 0:
            ends.append(i + 1)
            h = n = 0
    return ends + [len(data)] * (n > 0)


def test_cuts_by_the_plain_rule():
    r = random.Random(1)
    data = r.randbytes(120_000)
    for cdc in (chunking.Cdc.preset("8k"), chunking.Cdc.preset("16k"), chunking.Cdc.around(64, 256, 1024), chunking.Cdc.around(1, 16, 300)):
        for part in (data, data[:100], b"", data[:70_000]):
            assert chunking.cut_points(part, cdc) == plain_cuts(part, cdc)


def test_rolling_hashes_by_their_definitions():
    data = random.Random(2).randbytes(260)

    def rabin(window):
        v = 0
        for b in window:
            for _ in range(8):
                v = ((v << 1) & M64) ^ (0x1B if v >> 63 else 0)
            v ^= b
        return v

    rotated = lambda x, n: ((x << n % 64) | (x >> (64 - n % 64))) & M64 if n % 64 else x

    def buz(window):
        v = 0
        for i, b in enumerate(window):
            v ^= rotated(int(rolling.BUZ[b]), len(window) - 1 - i)
        return v

    for w in (1, 8, 40, 70):
        windows = [data[i : i + w] for i in range(len(data) - w + 1)]
        assert rolling.rabin_hashes(data, w) == list(map(rabin, windows))
        assert rolling.buz_hashes(data, w).tolist() == list(map(buz, windows))
        assert rolling.polynomial_hashes(data, w) == [sum(b * 257 ** (w - 1 - i) for i, b in enumerate(x)) % (2**61 - 1) for x in windows]
    assert rolling.gear_hashes(data).tolist()[-1] == sum(int(rolling.GEAR[b]) << i for i, b in enumerate(reversed(data)) if i < 64) & M64


def test_splitters():
    text = " ".join(f"word{i}" for i in range(200)) + "\n\n" + "x" * 300
    pieces = chunking.split_recursive(text, 64)
    assert max(map(len, pieces)) <= 64 and "".join(pieces).replace(" ", "") == text.replace(" ", "").replace("\n", "")
    assert chunking.overlapped(["abc", "de", "f"], 2) == ["abc", "bcde", "def"]
    assert chunking.split_sentences("One is. Two is! Three?", 15) == ["One is. Two is!", "Three?"]


def test_diffs_and_patches():
    r = random.Random(4)
    for _ in range(400):
        a, b = ([r.choice("abcdefg") + "\n" for _ in range(r.randrange(10))] for _ in range(2))
        if a and r.random() < 0.3:
            a[-1] = a[-1].strip()
        shortest = min(sum(op != "keep" for op, _ in diff.myers(a, b)), 99)
        for algorithm in (diff.myers, diff.patience):
            script = algorithm(a, b)
            assert [x for op, x in script if op != "insert"] == a and [x for op, x in script if op != "delete"] == b
            assert sum(op != "keep" for op, _ in script) >= shortest
            for context in (0, 1, 3):
                patch = diff.write_unified(diff.collapse_adjacent(script), context)
                assert diff.apply_unified("".join(a), patch) == "".join(b)
    assert diff.parse_unified("@@ -1,2 +1 @@\n a\n") is None and diff.apply_unified("x\n", "@@ -1 +1 @@\n-y\n+z\n") is None
    assert len(diff.hunks(diff.myers(list("axxxxxxxxb"), list("cxxxxxxxxd")), 3)) == 2


def test_phonetics():
    known = {"Smith": ("SM0", "XMT"), "Schmidt": ("XMT", "SMT"), "Thomas": ("TMS", "TMS"), "Catherine": ("K0RN", "KTRN"), "Wright": ("RT", "RT"), "Knight": ("NT", "NT"), "Caesar": ("SSR", "SSR"), "Arnow": ("ARN", "ARNF"), "": ("", "")}
    assert {n: phonetic.double_metaphone_keys(n) for n in known} == known
    for a, b in (("Чехов", "Chekhov"), ("Praha", "Прага"), ("Kraków", "Краків"), ("Београд", "Beograd")):
        assert phonetic.slavic_metaphone_key(a) == phonetic.slavic_metaphone_key(b) != ""


def test_banded_osa_and_lcs(spark):
    r = random.Random(5)
    pairs = [("".join(r.choice("abc") for _ in range(r.randrange(9))), "".join(r.choice("abc") for _ in range(r.randrange(9)))) for _ in range(150)]
    for a, b in pairs:
        d = kernels.osa_distance(a, b)
        for cutoff in (0, 1, 2, 4, 9):
            assert kernels.osa_within_distance(a, b, cutoff) == (d if d <= cutoff else None)
    df = spark.createDataFrame([("ca", "abc"), ("é", "e"), (None, "x")], "a string, b string")
    got = df.select(kernels.osa("a", "b"), kernels.lcs_distance(F.col("a"), F.col("b")), kernels.levenshtein_bytes(F.col("a"), F.col("b"))).collect()
    assert [tuple(x) for x in got] == [(3, 3, 3), (1, 2, 2), (None, None, None)]


def test_learned_distance_by_enumeration():
    model = learned.LearnedModel.uniform("ab")
    counts = learned.expected_counts(model, "a", "b")
    # three sequences lead from a to b: substitute, delete then insert, insert then delete
    p = 1 / 9
    total = p + 2 * p * p
    assert counts[("a", "b")] == pytest.approx(p / total) and counts[("a", "")] == pytest.approx(2 * p * p / total) and counts[learned.END] == 1
    assert model.distance("a", "c") == float("inf") and model.mass() == pytest.approx(1)
    assert model.distance("aa", "b") == pytest.approx(3 * -__import__("math").log(1 / 9))


def test_formats(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert one(formats.format_number(spark, F.lit(1234567.891), "de", 0, 2)) == "1.234.567,89"
    assert one(formats.format_number(spark, F.lit(-0.0), "en")) == "0" and one(formats.format_number(spark, F.lit(1234567.5), "hi")) == "12,34,567.5"
    assert one(formats.format_date(spark, F.lit("2024-09-22"), "en", "full")) == "Sunday, September 22, 2024" and one(formats.format_date(spark, F.lit("2024-02-30"))) is None
    assert one(formats.parse_iso_time(F.lit("24:00:00"))) is None and one(formats.parse_iso_time(F.lit("23:59:59"))) == 86399
    table = {("en", 1): "one", ("en", 1.5): "other", ("ru", 21): "one", ("ru", 1.5): "other", ("ar", 0): "zero", ("ar", 111): "many", ("pl", 22): "few", ("fr", 1.9): "one", ("cs", 1.5): "many", ("xx", 1): "other", ("lt", 1): "other"}
    for (lang, n), want in table.items():
        assert one(formats.plural_cardinal(F.lit(float(n)), lang)) == want, (lang, n)
    assert one(formats.plural_ordinal(F.lit(112.0), "en")) == "other" and one(formats.plural_ordinal(F.lit(22.0), "en")) == "two"


def test_near_duplicate_classes(spark):
    base = [f"g{i}" for i in range(20)]
    rows = [(1, base), (2, base[::-1]), (3, [*base[:19], "x"]), (4, ["other"]), (5, []), (6, None), (7, []), (None, base)]
    got = {r.id: (r.class_id, r.group_id, r.n_links) for r in joins.near_duplicate_classes(spark.createDataFrame(rows, "id int, grams array<string>"), id_col="id", gram_col="grams").collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), None: (1, 1, 1), 3: (3, 1, 1), 4: (4, 4, 0), 5: (5, 5, 0), 7: (5, 5, 0), 6: (5, 5, 0)}


def test_jaccard_join_by_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [f"g{int(r.random() ** 2 * 12)}" for _ in range(r.randrange(9))]) for i in range(80)] + [(None, ["g1"]), (200, None)]
    df = spark.createDataFrame(rows, "id int, grams array<string>")
    for threshold in (0.3, 0.6, 1.0):
        got = {(x.l_id, x.r_id) for x in joins.jaccard_join(df, df, id_col="id", gram_col="grams", threshold=threshold).collect()}
        sets = {i: set(g) for i, g in rows if g and i is not None}
        assert got == {(i, j) for i, a in sets.items() for j, b in sets.items() if len(a & b) >= threshold * len(a | b) - 1e-12}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (7, 8)], "u int, v int")
    assert {r.node: r.root for r in components.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert components.connected_components(edges.where("false")).count() == 0


def test_registry(spark):
    with pytest.raises(ValueError):
        registry.require_metric("osa")
    assert registry.require_metric("levenshtein").is_metric and not registry.METRICS["jaro"].is_metric
    assert [r.text for r in registry.exhaustive_texts(spark, "abc", 2).collect()] == list(registry.exhaustive("abc", 2))
    both = registry.exhaustive_pairs(spark, "ab", 2)
    assert both.count() == 49 and registry.differential_check(both, F.levenshtein("left", "right"), F.levenshtein("right", "left")).count() == 0


def test_simhash_128(spark):
    df = spark.createDataFrame([(["a", "b", "b"],), (["b", "a", "b"],), ([],), (None,)], "g array<string>")
    got = [r[0] for r in df.select(sketches.simhash_128_of(F.col("g"))).collect()]
    assert got[0] == got[1] and tuple(got[2]) == (0, 0) and got[3] is None
    weighted = spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string,bigint>").select(sketches.simhash_128(F.col("m"))).first()[0]
    assert weighted == got[0]


def test_batches_equal_pairs_one_by_one():
    r = random.Random(8)
    draw = lambda: "".join(r.choice("abcé中😀") for _ in range(r.randrange(14)))
    pairs = [(draw(), draw()) for _ in range(600)] + [("", ""), ("", "a"), ("a", ""), ("ca", "abc"), ("a" * 300, "ab" * 150)]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    for batch, one, kind in (
        (batch_kernels.osa, kernels.osa_distance, int), (batch_kernels.damerau, kernels.damerau_distance, int), (batch_kernels.lcs, kernels.lcs_length, int), (batch_kernels.jaro, kernels.jaro, float),
        (batch_kernels.needleman_wunsch(), kernels.needleman_wunsch, int), (batch_kernels.smith_waterman(2, -3, -2), lambda a, b: kernels.smith_waterman(a, b, 2, -3, -2), int),
    ):
        assert batch_kernels.batched(batch, kind)(left, right).tolist() == pytest.approx([one(a, b) for a, b in pairs], abs=1e-12)
    assert batch_kernels.batched(batch_kernels.osa, int)([], []).tolist() == []


def test_edit_join_by_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randrange(6)))) for i in range(60)] + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    for k in (1, 2):
        got = {(x.l_id, x.r_id): x.lev_dist for x in joins.edit_join(df, df, id_col="id", text_col="t", distance=k).collect()}
        far = lambda a, b: len(a) + len(b) if not a or not b else min(far(a[1:], b) + 1, far(a, b[1:]) + 1, far(a[1:], b[1:]) + (a[0] != b[0]))
        assert got == {(i, j): d for i, a in rows for j, b in rows if a is not None and b is not None and (d := far(a, b)) <= k}
