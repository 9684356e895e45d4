"""The dot of a capital İ divides no word, in a text, in a query and in the index."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions.text import folded_tokens, lower_tokens, tokens_of
from quern.plans import retrieval
from tests.oracle import agree


@pytest.mark.parametrize("cut", [folded_tokens, lower_tokens])
def test_dotted_capital_divides_no_word(spark, cut):
    text = "İstanbul DİYARBAKIR İ iİ2"
    want = ["istanbul", "diyarbakir", "i", "ii", "2"]
    assert spark.createDataFrame([(text,)], "text string").select(cut(F.col("text"))).first()[0] == want
    assert tokens_of(text) == want


def test_mean_length_is_that_of_the_sql(spark, tmp_path):
    texts = ["İstanbul and the sea", "the İ", "And İzmir İzmit"]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    agree(retrieval.bm25_stats(spark, str(tmp_path)), con, retrieval.ORACLE_SQL["bm25_stats"])
