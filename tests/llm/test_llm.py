import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import bpe, components, decontaminate, line_dedup, packing, quality_classifier, quality_rules, secrets, simhash_dedup, substring_dedup, token_counts, warc
from loomtext.llm.text import folded_words, plain_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(n, seed, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def brute_hits(doc, items, window=8):
    hit, found = set(), set()
    for item, ws in items:
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            for j in range(len(doc) - k + 1):
                if doc[j : j + k] == ws[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    return hit, found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30))
def test_automaton_against_brute_force(items, doc):
    named = [(str(i), w) for i, w in enumerate(items)]
    spans, found = decontaminate.ItemAutomaton(named, 4).scan(doc)
    hit, want = brute_hits(doc, named, 4)
    assert {i for a, b in spans for i in range(a, b)} == hit
    assert found == want


def test_decontamination_blocks_and_removal(spark):
    passage = words(12, 1, 1000)
    texts = [words(40, 2, 1000) + " " + passage + ". " + words(40, 3, 1000), passage, words(30, 4, 1000), None, ""]
    bench = spark.createDataFrame([(1, passage, "x"), (2, words(9, 5, 1000), "x"), (3, None, "x"), (None, "w1 w2", "x")], "item_id long, text string, doc_id string")
    docs = docs_of(spark, texts)
    one = {r.doc_id: r for r in decontaminate.contamination_report(docs, bench).collect()}
    many = {r.doc_id: r for r in decontaminate.contamination_report(docs, bench, block_bytes=20).collect()}
    assert one == many
    assert (one[0].n_hit, one[0].n_items, one[3].n_words, one[1].n_hit) == (12, 1, 0, 12)
    left = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs, bench).collect()}
    assert set(left) == {0, 2, 3, 4} and left[2] == texts[2] and left[3] is None
    assert passage not in left[0] and left[0].startswith(texts[0][:100])


def test_token_tree_equals_recount():
    r, encoder = random.Random(7), bpe.encoder()
    pieces = ["a", "b", " ", "  ", "\n", "'s", "'", "l", "re", "1", "23", "é", "ß", "!", "--", "\t", "中", "　", "'ll"]
    for _ in range(300):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(600)))
        tree = token_counts.CountTree.of(text, encoder)
        for _ in range(4):
            a = r.randrange(len(text) + 1)
            text, _ = tree.edit(text, (a, a + r.randrange(20), "".join(r.choice(pieces) for _ in range(r.choice([0, 3, 900])))), encoder)
            assert tree.total == sum(encoder.counts(bpe.pretokens(text))) and tree.chars[1] == len(text)


def test_token_counts_frames(spark):
    docs = docs_of(spark, ["mail me at a.b@c.org or 10.0.0.1 now", None, "", "plain words"])
    got = {r.doc_id: r for r in token_counts.recount(docs).collect()}
    assert got[0].n_edits == 2 and got[1].n_tokens == got[2].n_tokens_after == 0 and got[3].n_reencoded == 0
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("post").alias("text")))
    out = {r.doc_id: r for r in token_counts.apply_edits(token_counts.build_trees(docs).withColumn("edits", edits)).collect()}
    assert out[0].text.startswith("post me") and out[1].text == "post"
    assert all(r.n_tokens == sum(bpe.encoder().counts(bpe.pretokens(r.text))) for r in out.values())


def test_encoder_equals_tokenizers():
    own = Tokenizer.from_file(bpe.resolve(None))
    for text in ["Hello  world's 12 été ß!!", "\x1c\x85\xa0 a\n\n b", "中文　x", "", "   ", "don't I'LL"]:
        assert np.frombuffer(bpe.encoder().id_bytes(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2\nx", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}/w")
    whole = sorted(map(str, warc.read_archives(manifest, split_bytes=1 << 30).drop("path", "at").collect()))
    for split in (50, 333, 1000):
        assert sorted(map(str, warc.read_archives(manifest, split_bytes=split).drop("path", "at").collect())) == whole
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response"
    assert got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[1].payload_bytes == 1400
    assert got[4].record_type == "response" and got[5].payload == b"" and got[None].record_type == "response"
    assert warc.round_trip(spark, pages.where("false"), folder=f"file://{tmp_path}/e").count() == 0


def test_covering_meets_every_pair():
    r = random.Random(3)
    for threshold in (1, 3, 5, 7):
        for _ in range(40):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), threshold):
                y ^= 1 << b
            meets = False
            for shift, width in simhash_dedup.bit_blocks(threshold):
                code = simhash_dedup.Covering(width)
                part = np.array([(v >> shift) & ((1 << width) - 1) for v in (x, y)], dtype=np.uint64)
                rows, anchor, home = code.anchors(part)
                meets |= bool(set(anchor[(rows == 0) & home].tolist()) & set(anchor[rows == 1].tolist()))
            assert meets


@pytest.mark.parametrize("block_rows", [1 << 14, 2])
def test_simhash_components_against_all_pairs(spark, block_rows):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = set()
    for c in centres:
        for _ in range(25):
            x = c
            for b in r.sample(range(64), r.randrange(6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    up = list(range(len(fps)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {x.node: x.root for x in components.connected_components(simhash_dedup.links(frame, 3, block_rows)).collect()}
    got = {}
    for i, x in enumerate(fps):
        got.setdefault(roots.get(signed(x), signed(x)), set()).add(i)
    want = {}
    for i in range(len(fps)):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_edges(spark):
    text = words(300, 9)
    docs = docs_of(spark, [text, text.upper(), None, "", words(300, 10), text], [5, 3, 8, 7, 1, None])
    got = {r.doc_id: r for r in simhash_dedup.near_duplicate_report(docs).collect()}
    assert (got[5].component_id, got[3].component_id, got[8].component_id, got[1].component_id, got[None].component_id) == (3, 3, 7, 1, 3)
    assert got[7].fingerprint == "0" * 16
    kept = simhash_dedup.drop_near_duplicates(docs.unionAll(docs.where("doc_id = 3")))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 7] and kept.columns == docs.columns


def test_classifier(spark):
    good = [words(60, i, 500) + "." for i in range(120)]
    bad = [" ".join(w + "%%%" for w in words(60, i, 500).split()) for i in range(120)]
    docs = docs_of(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 120), None) for i in range(240)] + [(241, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels, bits=16).collect()}
    assert len(got) == 242
    held = [r for r in got.values() if r.held_out and r.doc_id < 240]
    assert held and all((r.score >= 0.5) == (r.doc_id < 120) for r in held)
    flat = quality_classifier.quality_scores(docs, labels.where("false"), bits=10).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]


def test_secrets():
    token = "Zk3vQ9xT7bLw2RmN8pYc4HdS6fJg"
    text = f"é password = 'abcdefghijkl' AKIA{'A' * 16} {'0123456789abcdef' * 2} tok {token} my_variable_name_2024_long token=short"
    kinds = {secrets.KINDS[k]: text[s:e] for s, k, e in secrets.spans_of(text)}
    assert kinds["assign"].endswith("abcdefghijkl") and kinds["access"] == "AKIA" + "A" * 16 and kinds["dense"] == token
    assert not any("my_variable" in v or "short" in v for v in kinds.values())
    assert secrets.spans_of("") == []


def test_line_dedup(spark):
    line = "This notice was issued on {} by the office of records."
    texts = [f"{line.format(i)}\n{words(30, i, 900).translate(str.maketrans('0123456789', 'abcdefghij'))}" for i in range(6)] + [None, "", "short line"]
    got = {r.doc_id: r for r in line_dedup.line_dedup_report(docs_of(spark, texts)).collect()}
    assert [got[i].n_dropped for i in range(6)] == [0, 1, 1, 1, 1, 1] and got[6].n_lines == 0 and got[7].n_lines == 1
    left = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert left[1] == texts[1].split("\n")[1] and left[6] is None and left[0] == texts[0]


def test_quality_rules(spark):
    good = "\n".join(words(20, i, 900).capitalize() + "." for i in range(5))
    junk = "\n".join("%%% ".join(words(20, i, 900).split()) for i in range(5))
    license_line = good + "\nThis work is licensed under the GNU General Public License, version 3."
    docs = docs_of(spark, [good, junk, None, "", license_line, "word " * 80])
    got = {r.doc_id: r for r in quality_rules.quality_report(docs).collect()}
    assert [got[i].kept for i in range(6)] == [True, False, False, False, True, False]
    assert got[5].n_repeat_words == 80 and got[2].n_words == 0
    left = {r.doc_id: r.text for r in quality_rules.clean_documents(docs).collect()}
    assert left == {0: good, 4: good}


def test_packing(spark):
    texts = [words(n, n, 3000) for n in [1, 5, 40, 90, 300, 900, 2500, 60, 61, 62]] + [None, ""]
    rows = packing.pack(docs_of(spark, texts), capacity=256, bucket_rows=3, with_ids=True).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for part in bins.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == np.frombuffer(bpe.encoder().id_bytes(t or ""), "<u4").tolist() + [2]
        assert all(r.length == 256 for r in own[1:])
    r = random.Random(2)
    for _ in range(50):
        h = {r.randrange(1, 65): r.randrange(1, 30) for _ in range(r.randrange(1, 40))}
        bins = packing.plan(h, 64)
        back = {}
        for sizes, times in bins:
            assert sum(sizes) <= 64
            for s in sizes:
                back[s] = back.get(s, 0) + times
        assert back == h


def test_substring_dedup(spark):
    shared = words(26, 77, 5000)
    texts = [words(30, i, 5000) + " " + shared + " " + words(11 + i, 50 + i, 5000) for i in range(5)]
    texts += [texts[0], texts[0], shared + " " + shared, "a " * 50, None, "", words(19, 77, 5000)]
    docs = docs_of(spark, texts)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = plain_words((t or "").encode())
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    for chunk_bytes in (1 << 22, 200):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, chunk_bytes=chunk_bytes).collect()}
        assert got == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    body = "\n".join(words(25, i, 900).capitalize() + "." for i in range(6))
    passage = words(20, 99, 9000)
    texts = [body, body, "\n".join(words(25, 40 + i, 900).capitalize() + "." for i in range(6)) + f"\n{passage}.", None, "", "Short."]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {0, 2}
    assert len(folded_words(passage.encode())) == 20 and isinstance(pa.array([1]), pa.Array)
