"""Shingle-set near-duplicates against brute force."""

import random

from loomtext.llm import shingle_dedup as sd
from test_llm import docs_of, words


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"edit{r.randrange(1000)}"
    return " ".join(w)


def test_signatures_are_complete():
    r = random.Random(5)
    for n in [5, 6, 7, 8, 9, 12, 20, 33, 60, 150, 400, 1500]:
        for t in range(40):
            a = words(n, r.randrange(1 << 30), 5000)
            b = edited(a, min(n, r.randrange(0, 2 + n // 45)), t)
            if t % 3 == 0:
                b += " " + words(r.randrange(1, 2 + n // 4), t, 5000)
            x, y = sd.shingle_set(a.encode()), sd.shingle_set(b.encode())
            assert sd.is_near(x, y) == (5 * len(shingles(a) & shingles(b)) >= 4 * len(shingles(a) | shingles(b)))
            assert not sd.is_near(x, y) or sd.may_be_near(len(x), sd.parities(x), len(y), sd.parities(y))
            assert not sd.is_near(x, y) or set(sd.signatures(x).tolist()) & set(sd.signatures(y).tolist())


def test_near_copies_match_brute_force(spark):
    texts = []
    for i in range(12):
        base = words(60 + 20 * i, i, 5000)
        texts += [base, *(edited(base, n, n) for n in (1, 2, 3, 4, 6))]
    parent = list(range(len(texts)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {find(i) for i in range(len(texts))}
    assert {r.doc_id for r in sd.drop_near_duplicates(docs_of(spark, texts)).collect()} == want and len(want) < len(texts)


def test_links_under_the_similarity_are_kept(spark):
    base = words(200, 3, 5000)
    texts = [base, edited(base, 12, 1), edited(base, 2, 2)]
    assert similarity(texts[0], texts[1]) < 0.8 <= similarity(texts[0], texts[2])
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), "").collect()} == {0, 1}


def test_rows_are_told_apart_by_text(spark):
    a, b = words(90, 1, 5000), words(90, 2, 5000)
    docs = docs_of(spark, [a, b, a, b, b], [7, 7, None, None, None])
    assert sorted((r.doc_id, r.text) for r in sd.drop_near_duplicates(docs).collect()) == sorted([(7, a), (7, b)])
    assert sd.drop_near_duplicates(docs.where("doc_id is null")).count() == 2
