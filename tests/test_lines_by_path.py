"""Lines are those of the SQL for empty texts, CR before an end of line, and rows that share a path."""

import duckdb
from pyspark.sql import functions as F

from quern.functions.text import split_lines
from quern.plans import corpus
from tests.oracle import agree


def test_lines_by_path_are_those_of_the_sql(spark, tmp_path):
    texts = ["", None, "\n", "a", "a\n", "a\r\nb\r", "a\r\r\nb\r\r\r", "\r", "a\r ", "é😀\n\n"]
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, "b\nc", "en", "s"), (0, "", "en", "s"), (1, "d", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    agree(corpus.split_lines(spark, str(tmp_path)), con, corpus.ORACLE_SQL["split_lines"])


def test_one_cr_goes_with_an_end_of_line(spark):
    texts = spark.createDataFrame([("a\r\r\nb\r \nc\r",)], "text string")
    assert texts.select(split_lines(F.col("text"))).first()[0] == ["a\r", "b\r ", "c"]
