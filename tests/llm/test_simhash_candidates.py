"""The pipeline's near-duplicates take their first candidates from SimHash links, each verified on the sets."""

import corpus_pipeline
from loomtext.llm import shingle_dedup as sd
from pyspark.sql import functions as F
from test_llm import docs_of, words


def apart(x, y):
    return ((x ^ y) & (1 << 64) - 1).bit_count()


def classes_of(docs):
    return sd._classes(docs, "doc_id", "text").select("_node", "_fp", F.col("_doc.text").cast("binary").alias("_text"))


def test_links_join_texts_of_near_fingerprints(spark):
    base = words(1200, 7, 5000)
    texts = [base, base + " more", words(60, 8, 5000), words(60, 9, 5000), "w x", "w y", "", None]
    classes = classes_of(docs_of(spark, [*texts, base.upper()]))
    rows = {(r._text or b"").decode().lower(): r for r in classes.collect()}
    assert len(rows) == classes.count() == 7 and rows[""]._fp == 0
    assert 0 < apart(rows[texts[0]]._fp, rows[texts[1]]._fp) <= 3 < apart(rows[texts[2]]._fp, rows[texts[3]]._fp)
    assert [{r.u, r.v} for r in sd.simhash_edges(classes).collect()] == [{rows[texts[0]]._node, rows[texts[1]]._node}]


def test_equal_fingerprints_are_verified(spark):
    rows = docs_of(spark, [words(80, i, 5000) for i in range(6)])
    named = rows.select(F.col("doc_id").alias("_node"), F.lit(5).cast("long").alias("_fp"), F.col("text").cast("binary").alias("_text"))
    assert sd.simhash_edges(named).count() == 0
    same = named.withColumn("_text", F.lit(words(80, 1, 5000)).cast("binary"))
    assert {(r.u, r.v) for r in sd.simhash_edges(same).collect()} == {(0, i) for i in range(1, 6)}


def test_the_stage_goes_by_simhash(spark, monkeypatch):
    base = words(1200, 7, 5000)
    docs = docs_of(spark, [base, base + " more", words(60, 8, 5000)])
    empty = "sig long, node long, least long"
    monkeypatch.setattr(sd, "shared_signatures", lambda texts: spark.createDataFrame([], empty))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 2}
