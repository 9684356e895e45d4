"""Records' terms are counted where they stand: one shuffle of packed postings, none of words."""

import pytest
from pyspark.sql import functions as F

from quern.functions import stemming
from quern.operators import postings as P
from quern.plans import retrieval
from tests.test_postings import assert_same, frame, records


def test_parts_of_blocks_are_made_without_a_shuffle(spark):
    memory = frame(spark, records(11, 300))
    parts = P.block_parts(memory, 3)
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    held = parts.filter("term = 'alpha'").select(F.inline(F.arrays_zip("key", F.transform("counts", lambda c: F.shiftright(c, 32)).alias("tf")))).collect()
    want = {r[0]: sum(w in ("alpha", "alphas") for w in (r[1] or "").split()) for r in records(11, 300)}
    assert {r[0]: r[1] for r in held} == {k: n for k, n in want.items() if n}


def test_long_batches_are_cut(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(stemming, "TOKENS", 5)
    lists = [["runs", "run", "été"], [], ["ete"] * 7, ["a"], [], ["b", "a", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array([["x"], *lists], pa.list_(pa.string())).slice(1)], ["w"])
    found, at = {}, 0
    for part, terms, row, term, tf in stemming.term_counts([batch], "w"):
        found |= {(at + r, terms[t]): n for r, t, n in zip(row.tolist(), term.tolist(), tf.tolist())}
        at += len(part)
    assert at == 6 and found == {(0, "run"): 2, (0, "ete"): 1, (2, "ete"): 7, (3, "a"): 1, (5, "b"): 2, (5, "a"): 1}


def test_stems_of_rows_that_share_a_key(spark, tmp_path):
    texts = [(1, "Runs running", "en"), (1, "run été", "en"), (2, "run", "en"), (3, None, "en")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in retrieval.analyze_stems(spark, str(tmp_path)).collect()} == {("run", 4, 2), ("ete", 1, 1)}


@pytest.mark.parametrize("word", ["andingly", "andedly", "andlyingly", "andlying", "andlyed"])
def test_words_that_the_sql_does_not_list_have_the_stem(word):
    """Larger tables hold them; by the published rules they lose -ing(ly) or -ed(ly), then -ly."""
    assert stemming.stem(word) == "and"


def test_an_index_of_many_slices_answers_as_ranking_does(spark):
    memory = frame(spark, records(12, 300))
    assert_same(spark, P.Postings(spark, f"{P.Scratch(spark, 'many').root}").build(memory, 16, 8), memory)
