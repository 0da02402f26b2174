"""Model files as tables, and texts as streams of pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.tokenizers import Tokenizer, read_ranks


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank) of a rank file, read by Spark: one base64 token and its rank a line; other lines are left out."""
    part = F.split("value", " ")
    lines = spark.read.text(path).where(F.size(part) == 2)
    return lines.select(F.unbase64(part[0]).alias("token"), part[1].cast("int").alias("rank"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a tokenizer description, added tokens included."""
    return Tokenizer.from_file(path).vocabulary(spark)


def text_pieces(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream (key, seq, piece, last) of the text files that come into a folder: a file is a key and its lines, with their ends, the pieces, in order.

    A file is read whole by one task, which suits the many files of a stream; ``last`` marks its last piece.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    pieces = F.regexp_extract_all("value", F.lit(r"([^\n]*\n|[^\n]+)"), F.lit(1))
    rows = files.select(F.input_file_name().alias("key"), pieces.alias("pieces")).select("key", F.size("pieces").alias("n"), F.posexplode("pieces").alias("seq", "piece"))
    return rows.select("key", F.col("seq").cast("long").alias("seq"), "piece", (F.col("seq") == F.col("n") - 1).alias("last"))


__all__ = ["ranks", "read_ranks", "text_pieces", "vocabulary"]
