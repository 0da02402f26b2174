import hashlib
import random
import re
import string
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomtext.llm import bpe, packing, quality_rules, secrets, token_counts
from test_llm import docs_of, words

BASE = (
    (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, lambda m: len(m[2]) >= 12),
    (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
    (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
)


def plain_base(text):
    found = [(m.start(), k, m.end()) for k, (pattern, flags, keep) in enumerate(BASE) for m in re.finditer(pattern, text, flags) if keep(m)]
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "ſecret", "secret", "\"", "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "A1B2C3D4E5F6G7", "0123456789abcdef", "deadbeef", "abcdefghijkl", "x", "é", "\n", "-", ".", "/", "Zk3vQ9xT7bLw2RmN8pY"]), max_size=14))
def test_base_spans_by_the_plain_patterns(parts):
    text = "".join(parts)
    assert [x for x in secrets.spans_of(text) if x[1] < 3] == plain_base(text)


def test_secret_frame(spark):
    texts = ["password = abcdefghijkl1234", None, "", "é token: short 0123456789abcdef0", "AKIA" + "B" * 16 + " password=abcdefghijkl1234"]
    docs = docs_of(spark, [*texts, texts[0]], [*range(5), 0]).selectExpr("*", "1 AS n_hex", "'x' AS spans")
    got = secrets.secret_report(docs).collect()
    assert len(got) == 6 and secrets.secret_report(docs.where("false")).count() == 0
    for r in got:
        want = plain_base(texts[r.doc_id] or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in want) for k in range(3))


def test_random_letters_are_found_and_words_are_not():
    r = random.Random(4)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    for letters, n, share in ((string.ascii_letters, 16, 0.95), (string.ascii_letters, 30, 1), (string.ascii_lowercase, 30, 0.9), (string.ascii_letters + string.digits, 18, 0.95)):
        assert sum(any(k == 3 for _, k, _ in secrets.spans_of(f"see {draw(letters, n)} here")) for _ in range(200)) >= share * 200
    for text in ("donaudampfschifffahrtsgesellschaft", "getHttpResponseCodeForRequest", "my_long_variable_name_2024", "path/to/some/other/file-name", "INTERNATIONALISATION", "123e4567-e89b-12d3-a456-426614174000", "A" * 40 + "-" + "9" * 40):
        assert not any(k == 3 for _, k, _ in secrets.spans_of(text)), text
    # the rest of a run around a base span is tested by itself
    assert [k for _, k, _ in secrets.spans_of("0123456789abcdef0123/Zk3vQ9xT7bLw2RmN8pYc4HdS")] == [2, 3]


def test_patterns_take_linear_time():
    for text in ("1111111-1111111-1111111-ab", "12345678" * 20_000 + "-ab", "A" * 200_000 + "b1", "a1_" * 60_000, "password" * 40_000, "token" + " " * 300_000, "0123456789abcdef/" * 20_000):
        began = time.time()
        secrets.spans_of(text)
        assert time.time() - began < 3, text[:30]
    began = time.time()
    token_counts.redactions("a" * 500_000 + " @ b@c.de " + "1.2.3.4 x@y.zz " * 20_000)
    assert time.time() - began < 3


def test_many_edits_take_linear_time():
    encoder = bpe.encoder()
    text = " ".join(f"word{i}" for i in range(100_000))
    tree = token_counts.CountTree.of(text, encoder)
    began = time.time()
    new, _ = tree.edit_all(text, [(i * 90, i * 90 + 3, "xy") for i in range(10_000)], encoder)
    assert time.time() - began < 5
    assert tree.total == sum(encoder.counts(encoder.pretokens(new)))


def test_edits_against_recount():
    r, encoder = random.Random(11), bpe.encoder()
    pieces = ["a", "b", " ", "  ", "\n", "'s", "'", "l", "1", "23", "é", "!", "--", "中", "　", "'ll", "<|endoftext|>", "<|endof", "text|>", "|>"]
    draw = lambda n: "".join(r.choice(pieces) for _ in range(n))
    for _ in range(300):
        text = draw(r.randrange(900))
        tree = token_counts.CountTree.of(text, encoder)
        for _ in range(3):
            edits = [(a, a + r.choice([0, 1, 3, 20]), draw(r.choice([0, 1, 3, 300]))) for a in (r.randrange(-2, len(text) + 3) for _ in range(r.choice([1, 2, 5, 30])))]
            want = text
            for a, b, x in reversed(token_counts.settled(edits, len(text))):
                want = want[:a] + x + want[b:]
            text, _ = tree.edit_all(text, edits, encoder)
            assert text == want and tree.chars[1] == len(text)
            assert tree.total == sum(encoder.counts(encoder.pretokens(text)))


def test_settled_edits():
    assert token_counts.settled([(5, 9, "x"), (None, 3, "y"), (1, None, "y"), (0, 6, None), (9, 4, "z"), (99, 120, "!")], 10) == [(0, 6, ""), (9, 9, "z"), (10, 10, "!")]


def test_edit_frames(spark):
    docs = docs_of(spark, ["one two three", None])
    trees = token_counts.build_trees(docs).selectExpr("*", "array(named_struct('text', 'TWO', 'start', 4, 'end', 7), named_struct('text', 'x', 'start', cast(null as int), 'end', 2), null) AS edits")
    assert sorted(r.text for r in token_counts.apply_edits(trees).collect()) == ["TWO", "one TWO three"]
    assert token_counts.recount(docs.where("false")).count() == 0


def test_added_tokens_as_in_the_library():
    own = Tokenizer.from_file(bpe.resolve(None))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endoftext|>\n", "<|endoftext", "中<|endoftext|>é", "Hello  world's 12 ß!!", ""]
    for text in texts:
        assert np.frombuffer(bpe.encoder().id_bytes(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
    own.encode_special_tokens = True
    for text in texts:
        assert np.frombuffer(bpe.encoder(None, False).id_bytes(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_packing_ids_and_sequences(spark):
    import zlib

    own = Tokenizer.from_file(bpe.resolve(None))
    texts = [words(n, n, 3000) for n in [1, 5, 40, 90, 300, 1200, 60, 61, 62, 700, 700, 700]] + [None, "", "end <|endoftext|> end"]
    docs = docs_of(spark, [*texts, texts[3]], [*range(len(texts)), 3]).selectExpr("*", "0 AS length", "'x' AS bucket")
    rows = packing.pack(docs, bucket_rows=2).collect()
    tokens = {i: own.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    for r in rows:
        ids = tokens[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024 for b in bins.values())
    total = sum(map(len, tokens.values())) + len(tokens[3])
    assert len(bins) <= -(-total // 1024) + 1 and packing.pack(docs.where("false")).count() == 0


def test_cleaning_by_a_plain_rule(spark):
    r = random.Random(8)
    lines = [words(12, i, 900).capitalize() + "." for i in range(60)] + ["", " \t", "no end here at all", "All rights reserved.", "a | b | c | d"]
    texts = ["\n".join(r.choice(lines) for _ in range(30)) for _ in range(30)]
    kept = {x.doc_id: x.text for x in quality_rules.clean_documents(docs_of(spark, texts), max_lost=1.0).collect()}
    bad = set(lines[62:])
    for i, text in kept.items():
        seen, want = set(), []
        for x in texts[i].split("\n"):
            if not x.strip():
                want.append(x)
            elif x not in bad and x not in seen:
                want.append(x)
                seen.add(x)
        assert text == "\n".join(want)
    assert kept
