"""Multisets, sort keys, locality-sensitive hashes, nearest vectors and token limits against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import collation, lsh, multisets, tokens
from loomtext.operators import nearest


def test_multisets(spark):
    rows = [(0, list("banana"), list("bandana")), (1, [], []), (2, None, ["a"]), (3, ["x", None, "x"], ["x"]), (4, [], ["a"])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").select("id", multisets.multiset(F.col("a")).alias("a"), multisets.multiset(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    out = df.select("id", "a", multisets.intersection_min(a, b).alias("lo"), multisets.union_max(a, b).alias("hi"), multisets.union_sum(a, b).alias("both"), multisets.difference_saturating(a, b).alias("less"), multisets.jaccard_multiset(a, b).alias("j"), multisets.dice_multiset(a, b).alias("d"), multisets.cosine(a, b).alias("c"), multisets.normalize_l2(a).alias("unit"))
    for got, (_, x, y) in zip(sorted(out.collect(), key=lambda r: r.id), rows, strict=True):
        if x is None:
            assert got.a is None and got.j is None
            continue
        m, n = (Counter(v for v in s if v is not None) for s in (x, y))
        assert (Counter(got.a), Counter(got.lo), Counter(got.hi), Counter(got.both), Counter(got.less)) == (m, m & n, m | n, m + n, m - n)
        low, high = (m & n).total(), (m | n).total()
        assert got.j == pytest.approx(low / high if high else 1.0)
        assert got.d == pytest.approx(2 * low / (m + n).total() if m + n else 1.0)
        norms = sum(v * v for v in m.values()) * sum(v * v for v in n.values())
        assert got.c == pytest.approx(sum(m[g] * n[g] for g in m) / norms**0.5 if norms else float(not m and not n))
        assert sum(v * v for v in got.unit.values()) == pytest.approx(1.0 if m else 0.0)


def test_sort_keys(spark):
    def order(words, key):
        df = spark.createDataFrame([(w,) for w in words], "w string")
        return [r.w for r in df.orderBy(key(F.col("w")), "w").collect()]

    assert order(["a10", "a9", "a009", "a", "b1", "a10b"], collation.natural_key) == ["a", "a009", "a9", "a10", "a10b", "b1"]
    assert order(["Zebra", "Äpfel", "Apfel", "Ära"], collation.din5007_key) == ["Apfel", "Äpfel", "Ära", "Zebra"]
    assert order(["Afel", "Äpfel", "Aaron", "Adel"], lambda c: collation.din5007_key(c, 2)) == ["Aaron", "Adel", "Äpfel", "Afel"]
    assert order(["The Zoo", "A Bee", "1984", "cat", "An Ant"], collation.library_key) == ["An Ant", "A Bee", "cat", "The Zoo", "1984"]
    assert spark.createDataFrame([(None,)], "w string").select(collation.natural_key(F.col("w"))).first()[0] is None


def test_p_stable(spark):
    for family in ("gaussian", "cauchy"):
        drawn, shift = lsh.projection(4000, 2.0, family, 7)
        assert 0 <= shift < 2 and abs(np.median(drawn)) < 0.1
        assert np.quantile(np.abs(drawn), 0.5) == pytest.approx(0.6745 if family == "gaussian" else 1.0, abs=0.06)
    v = [[1.0, 2.0, 3.0], [1.0, 2.0], None, [1.0, None, 3.0], [float("nan"), 1.0, 1.0]]
    drawn, shift = lsh.projection(3, 0.5, seed=3)
    df = spark.createDataFrame([(x,) for x in v], "v array<double>").select(lsh.p_stable_bucket(F.col("v"), 3, 0.5, seed=3))
    assert [r[0] for r in df.collect()] == [int(np.floor((np.dot(drawn, v[0]) + shift) / 0.5)), None, None, None, None]


def test_weighted_minhash(spark):
    a, b = {f"g{i}": 1.0 + i % 3 for i in range(40)}, {f"g{i}": 2.0 for i in range(20, 60)}
    exact = sum(min(a.get(g, 0), b.get(g, 0)) for g in a | b) / sum(max(a.get(g, 0), b.get(g, 0)) for g in a | b)
    df = spark.createDataFrame([(a, b)], "a map<string,double>, b map<string,double>")
    sketch = lambda c: lsh.weighted_minhash(F.col(c), 2000, 5)
    assert df.select(lsh.weighted_jaccard_estimate(sketch("a"), sketch("b"))).first()[0] == pytest.approx(exact, abs=0.04)
    assert lsh.weighted_minhash_values({"a": 0.0, "b": -1.0}, 4) == []
    assert lsh.weighted_minhash_values({"a": 2.0, "b": 1.0}, 16) == lsh.weighted_minhash_values({"b": 1.0, "a": 2.0, "c": 0.0}, 16)
    with pytest.raises(ValueError):
        lsh.weighted_minhash_values({"a": float("nan")}, 4)


@pytest.mark.parametrize("block", [1024, 3])
def test_nearest(spark, block):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(0, 4, 3).astype(float).tolist()) for i in range(120)] + [(200, [1.0]), (201, None), (None, [1.0, 1.0, 1.0]), (202, [float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = nearest.nearest(df.where("id % 10 = 0 and id < 120"), df, id_col="id", vector_col="v", k=4, block=block).collect()
    for q in range(0, 120, 10):
        want = sorted((round(float(np.linalg.norm(np.array(v) - rows[q][1])), 6), i) for i, v in rows[:120] if i != q)[:4]
        assert [(x.dist, x.item_id) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] == want
    assert nearest.nearest(df.where("false"), df, id_col="id", vector_col="v", k=4).count() == 0


def test_tokens(spark):
    vocabulary = {"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3, "aff": 4, "##a": 5}
    df = spark.createDataFrame([(["unaffable", "aff", "unx", "", None, "a" * 200],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(tokens.wordpiece(F.col("w"), vocabulary)).collect()] == [[1, 2, 3, 4, 0, 0], [], None]

    def drop(a, b, most):
        while len(a) + len(b) > most:
            a, b = (a[:-1], b) if len(a) >= len(b) else (a, b[:-1])
        return a, b

    cases = [(list(range(n)), list(range(m)), k) for n in (0, 1, 4, 7) for m in (0, 2, 5) for k in (0, 1, 3, 6, 20)]
    for k in (0, 1, 3, 6, 20):
        mine = [c for c in cases if c[2] == k]
        df = spark.createDataFrame([(a, b) for a, b, _ in mine], "a array<int>, b array<int>").select(tokens.truncate_pair(F.col("a"), F.col("b"), k).alias("p"))
        assert [(r.p.a, r.p.b) for r in df.collect()] == [drop(*c) for c in mine]
    one = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    a = F.col("a")
    assert one.select(tokens.truncate(a, 2), tokens.truncate(a, 2, "left"), tokens.pad(a, 5, 0), tokens.pad(a, 5, 0, "left"), tokens.pad(a, 2, 0)).first()[:] == ([1, 2], [2, 3], [1, 2, 3, 0, 0], [0, 0, 1, 2, 3], [1, 2, 3])
