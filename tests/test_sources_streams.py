import base64

from loomtext.operators import chunking
from loomtext.sources import models
from loomtext.streaming.chunking import chunk_stream
from loomtext.streaming.search import search_stream


def run(stream, name, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_rank_file(spark, tmp_path):
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([b"a", b"\xff", b"ab"])) + b"\n")
    assert {bytes(r.token): r.rank for r in models.ranks(spark, str(tmp_path / "r")).collect()} == {b"a": 0, b"\xff": 1, b"ab": 2}
    assert models.read_ranks(str(tmp_path / "r")) == {b"a": 0, b"\xff": 1, b"ab": 2}


def test_streamed_cuts_are_those_of_the_whole(spark, tmp_path):
    cdc = chunking.Cdc.around(32, 64, 256)
    texts = {}
    (tmp_path / "in").mkdir()
    for k in range(3):
        texts[k] = "".join(f"line {i * k} é of text {k}\n" for i in range(60 + k)) + "end" * (k % 2)
        (tmp_path / "in" / f"{k}.txt").write_text(texts[k], encoding="utf-8")
    (tmp_path / "in" / "9.txt").write_text("", encoding="utf-8")
    got = {}
    for r in run(chunk_stream(models.text_pieces(spark, str(tmp_path / "in")), cdc), "cuts", spark):
        got.setdefault(int(r.key.rpartition("/")[2][0]), []).append(r.end)
    assert {k: sorted(v) for k, v in got.items()} == {k: chunking.cut_points(t.encode(), cdc) for k, t in texts.items()}


def test_streamed_matches_overlap_and_span_pieces(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "abab\nab\nxaba"
    (tmp_path / "in" / "t").write_text(text)
    many = ["ab", "aba", "", "b\na"]
    found = run(search_stream(models.text_pieces(spark, str(tmp_path / "in")), many), "hits", spark)
    want = sorted((i, k) for k, p in enumerate(many) if p for i in range(len(text)) if text.startswith(p, i))
    assert sorted((r.position, r.pattern_index) for r in found) == want
