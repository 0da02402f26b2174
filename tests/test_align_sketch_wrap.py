import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import alignment, kernels, sketches, wrapping


def brute(a, b, s):
    """Global affine score over all alignments, by which kind of step came last."""

    @lru_cache(None)
    def go(i, j, last):
        if i == len(a) and j == len(b):
            return 0
        out = []
        if i < len(a) and j < len(b):
            out.append((s.match if a[i] == b[j] else s.mismatch) + go(i + 1, j + 1, "p"))
        if i < len(a):
            out.append(s.gap_extend + (s.gap_open if last != "d" else 0) + go(i + 1, j, "d"))
        if j < len(b):
            out.append(s.gap_extend + (s.gap_open if last != "i" else 0) + go(i, j + 1, "i"))
        return max(out)

    return go(0, 0, "p")


def cost(script, s):
    total, last = 0, None
    for op, _, _ in script:
        total += {"keep": s.match, "replace": s.mismatch}.get(op, s.gap_extend + (s.gap_open if op != last else 0))
        last = op
    return total


def test_alignments():
    r = random.Random(3)
    for _ in range(150):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(8))) for _ in range(2))
        for s in (alignment.LINEAR, alignment.BLAST, alignment.AFFINE, alignment.Scoring(2, -3, -4, -1)):
            got = alignment.align(a, b, s)
            assert got["score"] == alignment.align_score(a, b, s) == brute(a, b, s) == cost(got["script"], s)
            assert "".join(x or "" for _, x, _ in got["script"]) == a and "".join(y or "" for _, _, y in got["script"]) == b
            local = alignment.align(a, b, s, local=True)
            every = max(brute(a[i:j], b[k:m], s) for i in range(len(a) + 1) for j in range(i, len(a) + 1) for k in range(len(b) + 1) for m in range(k, len(b) + 1)) if len(a) + len(b) < 9 else None
            assert local["score"] == alignment.align_score(a, b, s, local=True) == cost(local["script"], s) and every in (None, local["score"])
            assert a[local["a_start"] :].startswith("".join(x or "" for _, x, _ in local["script"]))
        assert alignment.align_score(a, b, alignment.LINEAR) == kernels.needleman_wunsch(a, b)


def test_alignment_columns(spark):
    frame = spark.createDataFrame([("gattaca", "gataca"), ("", ""), (None, "x")], "a string, b string")
    rows = frame.select("a", "b", alignment.align_column(F.col("a"), F.col("b")).alias("x"), alignment.score_column(F.col("a"), F.col("b")).alias("s")).select("*", alignment.extract(F.col("x.script"), "a").alias("xa"), alignment.extract(F.col("x.script"), "b").alias("xb")).collect()
    assert (rows[0].s, rows[0].x.score, rows[0].xa, rows[0].xb) == (4, 4, "gattaca", "gataca")
    assert (rows[1].s, rows[1].x.script) == (0, []) and rows[2].s is None and rows[2].x.score is None


def test_sketches(spark):
    assert sketches.fnv1a([b"", b"a", b"foobar"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert int(sketches.splitmix(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF
    mask = (1 << 64) - 1
    r = random.Random(4)
    for k in (1, 7, 64):
        words = [f"w{r.randrange(50)}" for _ in range(r.randrange(1, 30))]
        mixed = [int(x) for x in sketches.splitmix(sketches.fnv1a([w.encode() for w in words]) ^ sketches._slots(5, 1)[0])]
        bins = {}
        for x in mixed:
            bins[x * k >> 64] = min(bins.get(x * k >> 64, mask), x)
        want = []
        for i in range(k):
            hop = next(d for d in range(k) if (i + d) % k in bins)
            v = bins[(i + hop) % k]
            want.append(v if hop == 0 else int(sketches.splitmix(np.array([v], np.uint64) ^ sketches.splitmix(np.array([hop], np.uint64)))[0]))
        assert sketches.one_permutation_values(words, k, 5).tolist() == want
    a, b = [f"x{i}" for i in range(300)], [f"x{i}" for i in range(100, 400)]
    for of in (sketches.minhash_values, sketches.one_permutation_values):
        assert (of(a, 256) == of(b, 256)).mean() == pytest.approx(0.5, abs=0.12)
        assert (of([], 4) == sketches.EMPTY).all()
    rows = spark.createDataFrame([(["a", "b", None],), ([],), (None,)], "g array<string>").select(sketches.minhash(F.col("g"), 4).alias("m"), sketches.one_permutation(F.col("g"), 4).alias("o"), sketches.simhash(F.col("g")).alias("s")).collect()
    assert len(rows[0].m) == len(rows[0].o) == 4 and rows[1].m == rows[1].o == [-1] * 4 and rows[1].s == 0 and rows[2].m is None and rows[2].s is None
    assert spark.range(1).select(sketches.simhash_cosine(F.lit(5), F.lit(5)).alias("v")).first().v == 1.0


def test_wrapping(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    text = F.lit("the quick brown fox\njumps")
    assert value(wrapping.wrap(text, 10)) == ["the quick", "brown fox", "jumps"]
    assert value(wrapping.fill(F.lit("abcdefgh"), 3)) == "abc\ndef\ngh" and value(wrapping.wrap(F.lit("abcdefgh"), 3, break_words=False)) == ["abcdefgh"]
    assert value(wrapping.fill(F.lit("a b c d"), 5, initial_indent="- ", subsequent_indent="  ")) == "- a b\n  c d"
    assert value(wrapping.reflow(F.lit("one two\nthree\n\nfour"), 20)) == "one two three\n\nfour"
    assert value(wrapping.wrap(F.lit(""), 5)) == [""] and value(wrapping.wrap(F.lit(None).cast("string"), 5)) is None
