"""The registered one-permutation query against its definition, run again and again in one session."""

import __spark_entry__
from loomtext.functions import sketches


def test_one_permutation_query(spark, tmp_path):
    texts = ["a b c d e f g h", "A B  c d e f\tg h\n", "a b c d e a b c d e", "too few words", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    w = [[] if t is None else t.lower().split() for t in texts]
    grams = [[" ".join(x[i : i + 5]) for i in range(len(x) - 4)] for x in w]
    want = {i: None if texts[i] is None else [x - (x >> 63 << 64) for x in sketches.one_permutation_values(g, 16).tolist()] for i, g in enumerate(grams)}
    assert want[0] == want[1] != want[2] and want[3] == want[4] == [-1] * 16
    for _ in range(3):
        rows = __spark_entry__.queries()["sketch_one_permutation"](spark, str(tmp_path))
        assert rows.dtypes == [("doc_id", "bigint"), ("o", "array<bigint>")]
        assert {r.doc_id: r.o for r in rows.collect()} == want
