"""The queries on lines and on grapheme clusters against their SQL, on texts with odd white space, CR and nulls."""

import duckdb
import pytest

import __spark_entry__

TEXTS = ["a b\n\nc \n", "  a\n   b\n", " a", "a\r\nb\r\n", "\r\n", "\r", "\x0b", "a \x85\n\xa0b\n \n", "\x0c \t\n x", "\x1c\nb", "é\r\nb", "a\r\nbcdef", "abc\r\né", "éééé", "👩‍👧x", "ab", "", None]


@pytest.mark.parametrize("name", ["lines_more", "str_graphemes"])
def test_equals_its_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
