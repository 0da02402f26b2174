"""What steps leave on disk."""

import os

from loomtext import session
from loomtext.llm import shingle_dedup as sd
from loomtext.session import materialise
from pyspark.sql import functions as F
from test_llm import docs_of, words


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    conf = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition("count")
    step = materialise(rows)
    assert not shuffle_files(spark) - before
    assert step.count() == rows.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf


def test_near_duplicates_delete_their_narrow_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_dir", lambda _: f"file://{tmp_path}")
    a = words(90, 1, 5000)
    kept = sd.drop_near_duplicates(docs_of(spark, [a, a + " more", words(90, 2, 5000)]))
    left = {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)}
    assert kept.count() == 2
    assert not left & {"shared-signatures", "profiles", "candidates"} and "shingle-classes" in left
