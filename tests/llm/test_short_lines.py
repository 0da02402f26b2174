"""Recurring lines of any length, and templates of longer ones."""

import random
import re

from test_llm import docs_of, words

from loomtext.llm import line_dedup


def test_short_recurring_lines(spark):
    import corpus_pipeline

    bodies = [words(30, i, 900).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(5)]
    docs = docs_of(spark, [f"All rights reserved.\n\n{b}\nLes." for b in bodies] + ["Only here.\n\n" + bodies[0][:20]])
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got[0] == f"All rights reserved.\n\n{bodies[0]}\nLes." and got[5].startswith("Only here.\n\n")
    assert all(got[i] == f"\n{bodies[i]}" for i in range(1, 5))


def plain_drops(docs, min_docs=4, depth=3):
    """{(document, line)} by the docstring's rules, one line at a time."""
    rows = []
    for i, text in docs:
        for k, line in enumerate(text.split("\n") if text is not None else []):
            t = tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
            if t and 2 * sum(w != "<*>" for w in t) >= len(t):
                rows.append((i, k, t))
    leaf = lambda t: (len(t), t[:depth])
    support = {}
    for t in {t for _, _, t in rows}:
        for p in range(depth, len(t)):
            support[leaf(t), p, t[p]] = support.get((leaf(t), p, t[p]), 0) + len({i for i, _, u in rows if u == t})
    named = {}
    for i, k, t in rows:
        general = tuple(w if p < depth or support[leaf(t), p, w] >= min_docs else "<*>" for p, w in enumerate(t)) if len(t) > 2 * depth else t
        named.setdefault(general if 2 * sum(w != "<*>" for w in general) >= len(t) else t, []).append((i, k))
    return {(i, k) for at in named.values() if len({i for i, _ in at}) >= min_docs for i, k in at if i != min(i for i, _ in at)}


def test_templates_by_the_plain_rule(spark):
    r = random.Random(6)
    draw = lambda n, size: " ".join(f"w{'abcdefghijklmnop'[r.randrange(size)]}" for _ in range(n))
    lines = [draw(r.choice([1, 2, 5, 7, 8, 12]), r.choice([2, 4, 16])) for _ in range(40)] + ["one {} two three four {} five six", "{} {} a", "page {}", "", "  "]
    texts = ["\n".join(r.choice(lines).format(*(r.choice(["7", "x", "yy", "b2"]) for _ in range(2))) for _ in range(r.randrange(1, 9))) for _ in range(60)] + [None, ""]
    docs = docs_of(spark, texts).selectExpr("*", "1 AS _a", "2 AS _line", "3 AS _drop")
    gone = plain_drops(list(enumerate(texts)))
    kept = {x.doc_id: x.text for x in line_dedup.drop_recurring_lines(docs).collect()}
    assert gone and len(kept) == 62
    for i, text in enumerate(texts):
        assert kept[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone))
    assert {x.doc_id: x.n_dropped for x in line_dedup.line_dedup_report(docs).collect()} == {i: sum(d == i for d, _ in gone) for i in range(62)}


def test_rows_of_one_document_and_without_id(spark):
    text = "one line that several rows of a document share"
    same = docs_of(spark, [text] * 4 + ["x"], [1, 1, 1, 1, 2])
    assert sum(r.n_dropped for r in line_dedup.line_dedup_report(same).collect()) == 0
    many = docs_of(spark, [text] * 6, [1, 2, 3, 4, None, None])
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.line_dedup_report(many).collect()) == [(0, 1), (0, 1), (1, 0), (2, 1), (3, 1), (4, 1)]
    assert line_dedup.line_dedup_report(many.where("false")).count() == 0
