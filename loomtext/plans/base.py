"""How queries are registered: a Spark function by name, with the DuckDB SQL that it must equal where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def scalar(name: str, table: str, key: str, columns: dict, oracle: str | None) -> None:
    """A query of one table: its key and computed columns."""
    QUERIES[name] = lambda spark, sf_dir: read(spark, sf_dir, table).select(key, *[c().alias(n) for n, c in columns.items()])
    if oracle:
        ORACLES[name] = f"SELECT {key}, {oracle} FROM {table}"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: Texts of customers and suppliers with a common number, which grow with the tables.
NAME_PAIRS = "(SELECT c_custkey AS id, c_name || ' ' || c_mktsegment AS x, s_name || ' ' || c_mktsegment || s_nationkey AS y FROM customer JOIN supplier ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey)"


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): every customer with one supplier, an equi-join."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    c = c.join(F.broadcast(s.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))
    both = c.join(s, F.col("c_custkey") % F.col("n") == F.col("s_suppkey"))
    return both.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("x"), F.concat(F.col("s_name"), F.lit(" "), F.col("c_mktsegment"), F.col("s_nationkey").cast("string")).alias("y"))


def pair(name: str, columns: dict, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: name_pairs(spark, sf_dir).select("id", *[c().alias(n) for n, c in columns.items()])
    if oracle:
        ORACLES[name] = f"SELECT id, {oracle} FROM {NAME_PAIRS}"
