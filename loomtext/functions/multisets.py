"""Gram multisets as maps from gram to count, and their vectors, in JVM expressions.

``gram_counts`` counts relationally with map-side combining, for long texts; the Column functions take the maps
it gathers, one per row. Null maps give null; counts of zero or less don't occur in results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_counts(df: DataFrame, *, id_col: str, gram_col: str) -> DataFrame:
    """(id, gram, n): how often each row id has each gram; null grams are left out."""
    return df.select(F.col(id_col).alias("id"), F.explode(gram_col).alias("gram")).where("gram is not null").groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n"))


def multiset(grams: Column) -> Column:
    """Map from gram to count. Sorts once and measures runs, so it is not quadratic in the number of grams.

    Give a Python function the maps that ``gram_counts`` gathers instead: in one tried plan Spark would not hand this expression to one.
    """
    tidy = F.sort_array(F.filter(grams, lambda x: x.isNotNull()))

    def counted(g: Column) -> Column:
        edge = F.filter(F.sequence(F.lit(0), F.size(g)), lambda i: (i == 0) | (i == F.size(g)) | (F.get(g, i) != F.get(g, i - 1)))
        return F.transform(F.array(edge), lambda e: F.map_from_arrays(F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda i: F.get(g, i)), F.zip_with(F.slice(e, F.lit(2), F.size(e) - 1), F.slice(e, F.lit(1), F.size(e) - 1), lambda b, a: (b - a).cast("long"))))[0]

    return F.transform(F.array(tidy), lambda g: F.when(F.size(g) > 0, counted(g)).when(g.isNotNull(), F.create_map().cast("map<string,bigint>")))[0]


def _zipped(a: Column, b: Column, f) -> Column:
    return F.map_filter(F.map_zip_with(a, b, lambda _, x, y: f(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))), lambda _, n: n > 0)


def intersection_min(a: Column, b: Column) -> Column:
    return _zipped(a, b, F.least)


def union_max(a: Column, b: Column) -> Column:
    return _zipped(a, b, F.greatest)


def union_sum(a: Column, b: Column) -> Column:
    return _zipped(a, b, lambda x, y: x + y)


def difference_saturating(a: Column, b: Column) -> Column:
    return _zipped(a, b, lambda x, y: x - y)


def total_count(a: Column) -> Column:
    return F.aggregate(F.map_values(a), F.lit(0).cast("long"), lambda s, x: s + x)


def distinct_count(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def jaccard_multiset(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima; two empty multisets give 1."""
    most = total_count(union_max(a, b))
    return F.when(most == 0, 1.0).otherwise(total_count(intersection_min(a, b)) / most)


def dice_multiset(a: Column, b: Column) -> Column:
    both = total_count(a) + total_count(b)
    return F.when(both == 0, 1.0).otherwise(2 * total_count(intersection_min(a, b)) / both)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: (F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0))).cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two count vectors under one root; both empty give 1, one empty gives 0."""
    norms = dot(a, a) * dot(b, b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(norms == 0, 0.0).otherwise(dot(a, b) / F.sqrt(norms))


def normalize_l2(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform_values(a, lambda _, x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def normalize_l1(a: Column) -> Column:
    total = F.aggregate(F.map_values(a), F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.transform_values(a, lambda _, x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)
