"""Scripts of empty texts and of texts that end with an end of line, written out by hand: an empty text has no line, and
an end of line at a text's end opens none. The SQL takes either for one more line, so it is no measure there."""

from hashlib import sha256

from quern.plans import patch

SCRIPTS = {
    0: ("", 0.0, ""),
    1: ("", 1.0, "+\n+edit 1"),
    2: ("", 1.0, "+\n+edit 2"),
    3: ("", 0.0, ""),
    4: ("", 1.0, "+edit 4"),
    5: ("a\nb\n", 1 / 2, "-a\n b\n"),
    8: ("a\nb\n", 0.0, " a\n b\n"),
    9: ("a\n", 1.0, "-a\n+edit 9"),
}


def test_scripts_of_empty_texts_and_of_ends_of_line(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _, _) in SCRIPTS.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["id"]: (r["ratio"], r["diff_sha256"]) for r in patch.line_diff(spark, str(tmp_path)).collect()}
    assert found == {i: (ratio, sha256(script.encode()).hexdigest()) for i, (_, ratio, script) in SCRIPTS.items()}
