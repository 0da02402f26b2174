"""Lists of texts go into Arrow memory piece by piece."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.functions import batches, segments


def test_lists_are_held_a_piece_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(batches, "HELD", 10)
    seen = []
    array = pa.array
    monkeypatch.setattr(batches.pa, "array", lambda x, kind: seen.append(len(x)) or array(x, kind))
    out = batches._lists(str.split, array(["a b", None, "c " * 9, "", "d"] * 3), pa.list_(pa.string()))
    assert out.to_pylist() == [["a", "b"], None, ["c"] * 9, [], ["d"]] * 3 and max(seen) == 5 and len(seen) > 3
    texts = ["a b-c", None, "", "can't 3.5"] * 3
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(segments.words("t").alias("w"), segments.word_indices("t").alias("i"), segments.segments_with_offsets(F.col("t"), "words").alias("o")).collect()
    for t, row in zip(texts, got, strict=True):
        assert row.w == (None if t is None else segments.word_list(t))
        assert row.i is None if t is None else [x.text for x in row.i] == row.w
        assert row.o is None if t is None else "".join(x.text for x in row.o) == t
