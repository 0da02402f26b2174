import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import brute_hits, docs_of, words

from loomtext.llm import decontaminate, line_dedup, packing, quality_classifier, quality_rules, secrets, simhash_dedup, substring_dedup, token_counts, warc
from loomtext.llm.text import lower_words


def test_contamination_columns_cannot_clash(spark):
    passage = words(12, 1, 1000)
    bench = spark.createDataFrame([(1, passage), (1, passage)], "item_id long, text string")
    docs = docs_of(spark, [words(40, 2, 1000) + " " + passage, passage, None]).selectExpr("*", "1 AS _n", "array(2) AS _spans", "'x' AS _items", "3 AS n", "4 AS spans", "5 AS items", "6 AS row")
    left = decontaminate.remove_contamination(docs, bench)
    assert left.columns == docs.columns and {r.doc_id: r.text for r in left.collect()} == {0: words(40, 2, 1000) + " ", 2: None}
    other = docs.withColumnsRenamed({"text": "body", "doc_id": "key"}).selectExpr("*", "'t' AS text", "'d' AS doc_id")
    got = decontaminate.remove_contamination(other, bench, text_col="body")
    assert {(r.key, r.body, r.text, r.doc_id) for r in got.collect()} == {(0, words(40, 2, 1000) + " ", "t", "d"), (2, None, "t", "d")}
    report = decontaminate.contamination_report(docs.unionAll(docs), bench).collect()
    assert len(report) == 6 and sorted(r.n_hit for r in report) == [0, 0, 12, 12, 12, 12] and {r.n_items for r in report} == {0, 1}
    assert decontaminate.contamination_report(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.remove_contamination(docs.where("false"), bench).count() == 0


def test_automaton_of_one_word_and_many_states():
    automaton = decontaminate.ItemAutomaton([("x", [b"a"] * 3000), ("y", [b"b"])], 8)
    assert automaton.scan([b"a"] * 5000 + [b"c", b"b"]) == ([(0, 5000), (5001, 5002)], {"x", "y"})
    r = random.Random(3)
    items = [(str(i), [b"w%d" % r.randrange(30) for _ in range(r.randrange(60))]) for i in range(60)]
    automaton = decontaminate.ItemAutomaton(items, 5)
    for _ in range(40):
        doc = [b"w%d" % r.randrange(31) for _ in range(30)] + (items[r.randrange(60)][1])[:20]
        hit, want = brute_hits(doc, items, 5)
        spans, found = automaton.scan(doc)
        assert {i for a, b in spans for i in range(a, b)} == hit and found == want


def test_automaton_memory_by_block():
    r = random.Random(1)
    vocabulary = [b"w%d" % i for i in range(30_000)]
    items = [(str(i), [vocabulary[int(r.random() ** 3 * 30_000)] for _ in range(200)]) for i in range(800)]
    size = sum(len(w) + 1 for _, ws in items for w in ws)
    automaton = decontaminate.ItemAutomaton(items)
    arrays = [automaton.next.keys, automaton.next.to, automaton.link, automaton.length, automaton.top, automaton.window_states, automaton.window_starts, automaton.window_items]
    assert sum(len(a) * a.itemsize for a in arrays) < 20 * size


def plain_fingerprint(text):
    ws = lower_words((text or "").encode())
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_the_plain_rule(spark):
    texts = [words(n, n, 50) for n in (1, 2, 3, 4, 10, 400)] + ["ÀB c", "A B\x0bC\x85D", None, "", words(10, 10, 50).upper()]
    docs = docs_of(spark, [*texts, texts[4]], [*range(len(texts)), 4]).selectExpr("*", "1 AS fp", "2 AS n", "3 AS hot_fp")
    got = simhash_dedup.near_duplicate_report(docs).collect()
    assert len(got) == len(texts) + 1
    assert all(r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}" for r in got)
    assert simhash_dedup.near_duplicate_report(docs.where("false")).count() == 0


def test_crowded_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "HOT_ROWS", 3)
    texts = [words(60, 1, 400)] * 9 + [words(60, 2, 400)] * 2 + [words(60, 3, 400), None, "", None, "", ""]
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicate_report(docs_of(spark, texts)).collect()}
    assert got == {i: 0 if i < 9 else 9 if i < 11 else 11 if i == 11 else 12 for i in range(17)}


def test_windows_are_told_apart_by_both_halves(spark, monkeypatch):
    texts = [words(30, i, 5000) for i in range(4)] + [words(30, 0, 5000)]
    high = substring_dedup._rolled

    def weak(values, length):
        return high(values, length) if length < 20 else high(values, length) & np.uint64(1)

    # windows that differ in the other half only are not removed
    table = pa.table({"doc_id": pa.array(range(5), pa.int64()), "text": pa.array([t.encode() for t in texts], pa.binary()), "chunk": pa.array([0] * 5, pa.int64())})
    chunk = substring_dedup._Chunk(table)
    a, b = chunk.windows(0, 20), chunk.windows(4, 20)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and not (a[0] == a[1]).any() and not (a[1] == chunk.windows(1, 20)[1]).any()
    monkeypatch.setattr(substring_dedup._Chunk, "windows", lambda self, i, n: (weak(self.hashes[i], n), high(self._low[self._numbers[i]], n) >> np.uint64(32)))
    rows = substring_dedup._window_rows((pa.scalar(0),), table, pa.table({"h": np.concatenate([h for _, _, h in chunk.anchors(8)]).view(np.int64)}), 20, 8)
    assert sum(m + 1 for m in rows["more"].to_pylist() if m >= 0) == 11


def test_salted_copies(spark):
    text = words(200, 1, 5000)
    docs = docs_of(spark, [text] * 40 + [words(50, 2, 5000), None, ""]).selectExpr("*", "1 AS chunk", "2 AS h", "3 AS key")
    for chunk_bytes in (1 << 22, 300):
        got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs, chunk_bytes=chunk_bytes).collect()}
        assert got == {0: (200, 0), **{i: (200, 200) for i in range(1, 40)}, 40: (50, 0), 41: (0, 0), 42: (0, 0)}
    assert substring_dedup.substring_dedup(docs.where("false")).count() == 0


def test_revisits_with_repeated_and_null_ids(spark, tmp_path):
    big, other = "x" * 1500, "y" * 1500
    rows = [(1, "a", big), (1, "b", big), (1, "c", other), (9, "d", big), (9, "e", big), (None, "f", big), (None, "g", other), (3, None, None), (4, "h", "z" * 999), (5, "i", "z" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS last", "3 AS payload")
    planned = warc.plan_records(pages).collect()
    assert sorted((r.url or "", r.refers_to) for r in planned if r.refers_to) == [("a", 9), ("b", 9)]
    got = warc.round_trip(spark, pages, folder=f"file://{tmp_path}/w").collect()
    assert len(got) == 10 and sum(r.record_type == "revisit" for r in got) == 2
    assert all(r.payload_digest == hashlib.sha1(("" if r.page_id == 3 else "z" * 999).encode()).hexdigest() for r in got if r.page_id in (3, 4, 5))


def test_classifier_held_out_and_bounds(spark):
    good = [words(60, i, 500) + "." for i in range(150)]
    bad = [words(20, i, 500) + " buy now " * 4 for i in range(150)]
    docs = docs_of(spark, [*good, *bad]).selectExpr("*", "1 AS score", "0 AS label", "1 AS quality")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(0, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels, bits=16).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 300 and 30 < len(held) < 90 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 150) for r in held]) > 0.95
    # labels of the held-out fold don't matter, nor does what lies past the bound
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_classifier.quality_scores(docs, turned, bits=16).collect()) == sorted(got)
    weights = quality_classifier.fit(docs, labels, bits=16, max_features=2000)
    assert 0 < np.count_nonzero(weights) < np.count_nonzero(quality_classifier.fit(docs, labels, bits=16))
    assert quality_classifier.quality_scores(docs.where("false"), labels, bits=10).count() == 0


@pytest.mark.parametrize("query", [quality_rules.quality_report, line_dedup.line_dedup_report, secrets.secret_report, token_counts.recount, packing.pack, substring_dedup.substring_dedup, simhash_dedup.near_duplicate_report])
def test_null_and_repeated_rows(spark, query):
    docs = docs_of(spark, [words(70, 1, 300) + ".", None, "", words(70, 1, 300) + "."], [1, None, 2, 1])
    assert len({r.doc_id for r in query(docs).collect()}) == 3
