from collections import Counter

import corpus_pipeline
from quern.llm.mixing import mix_table
from tests.llm.cases import ascii_lower, frame
from tests.llm.test_simhash import brute as near


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "src0", 0), (9002, "123 !!", "en", "src0", 6), (9003, "THE THE the", None, "src1", 11), (9004, "the the the", "en", "src1", 11)], docs.schema)
    docs = docs.unionByName(extra)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.collect()
        kept = spark.createDataFrame(stage(spark, kept, None).collect(), docs.schema)
        assert kept.columns == docs.columns
        after = kept.collect()
        if name == "language_id":
            assert Counter(r["doc_id"] for r in before) - Counter(r["doc_id"] for r in after) == Counter([9001, 9002])
            assert all(r["lang"] for r in after)
        if name == "exact_dedup":
            latest = {}
            for r in before:
                latest[ascii_lower(r["text"])] = max(r["doc_id"], latest.get(ascii_lower(r["text"]), -1))
            assert sorted(r["doc_id"] for r in after) == sorted(latest.values())
        if name == "near_dedup":
            assert {r["doc_id"] for r in after} == {k[2] for k in near([tuple(r) for r in before])}
        if name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mix_table(spark.createDataFrame(before, docs.schema)).collect()}
            assert Counter(r["doc_id"] for r in after) == Counter({i: c for i, c in copies.items() if c})
    last = corpus_pipeline.STAGES[-1][1](spark, kept, None).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in kept.collect())


def test_empty_table(spark):
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, None)
        assert out.collect() == []


def test_texts_with_letters_stay_where_no_language_was_learned(spark):
    texts = ["some text", None, "12 !!", "été", ""]
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    out = corpus_pipeline.language_id(spark, docs, None).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out) == [(0, "some text", None), (3, "été", None)]


def test_odd_rows_and_columns_that_clash(spark):
    """Column names with dots and those that the stages would use themselves come through every stage."""
    names = ["doc_id long", "text string", "lang string", "source string", "`a.b` int", "`c``d` map<string,int>", "_lang_pred string", "__lang_pred string", "h int", "id int", "sha int", "keep int", "group int", "Whole int", "copies int", "last int", "row int", "size int", "copy int"]
    texts = [(1, "one text here"), (1, "one text here"), (2, None), (3, ""), (None, "no id at all"), (None, "no id at all"), (4, "very long " * 100_000), (5, "VERY long " * 100_000), (6, "one text HERE")]
    rows = [(i, t, None, [None, "s"][k % 2], k, {"k": k}, *["x"] * 2, *[k] * 11) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns
        out.collect()
    labelled = spark.createDataFrame([(*r[:2], "en", *r[3:]) for r in rows], docs.schema)
    kept = corpus_pipeline.exact_dedup(spark, corpus_pipeline.language_id(spark, labelled, None), None).collect()
    # of the two rows that repeat id and text the one that comes first as JSON stays, and goes to the larger id
    assert sorted(str(r["doc_id"]) for r in kept) == ["5", "6", "None"]
    assert [r["a.b"] for r in kept if r["doc_id"] is None] == [4]
