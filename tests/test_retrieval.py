from quern.operators import retrieval as R

SCHEMA = "key string, content string, tags array<string>, project string, created_at timestamp_ntz, agent_id string, embedding array<double>"


def memory(spark, rows):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, c, tags, p, t + datetime.timedelta(minutes=i), None, e) for i, (k, c, tags, p, e) in enumerate(rows)], SCHEMA)


def vectors(m):
    return m.select("project", "key", "embedding")


def one_hot(k, n=384):
    return [1.0 if i == k else 0.0 for i in range(n)]


def query(spark, vector):
    return spark.createDataFrame([(vector,)], "qvec array<double>")


def test_vector_and_text_hits_are_both_found(spark):
    m = memory(spark, [("a", "Reciprocal ranks", [], "p", one_hot(0)), ("b", "other words", [], "p", one_hot(1))])
    got = R.recall(m, "p", "reciprocals rank", vectors(m), query(spark, one_hot(1)), 2).collect()
    assert {r["key"] for r in got} == {"a", "b"} and {r["search_mode"] for r in got} == {"vector+bm25"}
    best = max(got, key=lambda r: r["score"])
    assert best["key"] == "a"  # second by vector and first by text


def test_without_a_vector_text_decides(spark):
    m = memory(spark, [("a", "one two two", [], "p", None), ("b", "one", None, "p", None), ("c", "two", [], "q", None), ("d", "two", ["roi"], "p", None)])
    got = R.recall(m, "p", "Two").collect()
    assert [(r["key"], r["search_mode"]) for r in got] == [("a", "bm25")]


def test_both_fusions_agree_and_are_symmetric(spark):
    left = spark.createDataFrame([(f"k{i}", float(i)) for i in range(20)], "key string, score double")
    right = spark.createDataFrame([(f"k{i}", float(-i)) for i in range(10, 30)], "key string, score double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.fused(left, right)) == rows(R.fused_by_union(left, right)) == rows(R.fused(right, left))


def test_limit_is_at_most_fifty_and_formatting_cuts(spark):
    m = memory(spark, [(f"k{i:03d}", "word " * 200, [], "p", None) for i in range(60)])
    got = R.recall(m, "p", "words", limit=99)
    assert got.count() == 50
    entry = R.formatted(got, 100).first()["entry"]
    assert entry.endswith("... [output truncated]") and "by Unknown" in entry


def test_query_and_text_go_through_one_analyzer(spark):
    m = memory(spark, [("a", "Running quickly, Été", [], "p", None), ("b", "быстрый 漢字 x2", [], "p", None), ("c", None, [], "p", None), ("d", "dying", [], "p", None)])
    keys = lambda q: [r["key"] for r in R.recall(m, "p", q).collect()]
    assert keys("run") == keys("Runs") == keys("ETE quick") == ["a"]
    assert keys("Быстрый") == keys("漢字") == keys("2 x") == ["b"]
    assert keys("die") == ["d"]
    assert keys("") == keys("...") == keys("run missing") == []


def test_every_word_with_a_stem_starts_like_it(spark):
    from quern.functions.stemming import stem

    words = {x for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for x in R.tokens_of(r["text"] or "")}
    words |= set("dying lying tying skies skis happily gently news consistency relational ugly ties".split())
    assert all(w.startswith(R._start(stem(w))) for w in words)


def test_an_embedder_that_fails_leaves_the_text(spark):
    def broken(text):
        raise RuntimeError("no model")

    m = memory(spark, [("a", "some words", [], "p", one_hot(0)), ("b", "others", [], "p", one_hot(1))])
    mode = lambda embed: {(r["key"], r["search_mode"]) for r in R.recall_by_text(m, "p", "word", vectors(m), embed, 1).collect()}
    assert mode(broken) == mode(None) == {("a", "bm25")}
    assert mode(lambda text: one_hot(0)) == {("a", "vector+bm25")}


def test_storing_replaces_record_and_vector(spark):
    m = memory(spark, [("a", "old", ["x"], "p", one_hot(0)), ("b", "kept", [], "p", one_hot(1))])
    rows, v = m.drop("embedding"), vectors(m)
    record = {"key": "a", "content": "new words", "tags": ["y"], "project": "p"}
    for embed, want in ((lambda text: one_hot(2), one_hot(2)), (None, None)):
        now, then = R.remembered(rows, v, record, embed)
        assert {r["key"]: (r["content"], r["tags"]) for r in now.collect()} == {"a": ("new words", ["y"]), "b": ("kept", [])}
        assert {r["key"]: r["embedding"] for r in then.collect()} == {"a": want, "b": one_hot(1)}


def test_storing_adds_counters_and_leaves_other_projects_alone(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    m = spark.createDataFrame(
        [("k", "old", ["x"], "p1", t, None, 5, None), ("k", "other", ["x"], "p2", t, None, 7, 8)],
        "key string, content string, tags array<string>, project string, created_at timestamp_ntz, agent_id string, token_saved long, token_usage long",
    )
    v = spark.createDataFrame([("p1", "k", one_hot(0, 3)), ("p2", "k", one_hot(1, 3))], "project string, key string, embedding array<double>")
    now, then = R.remembered(m, v, {"project": "p1", "key": "k", "content": "new", "token_saved": 2})
    got = {r["project"]: (r["content"], r["token_saved"], r["token_usage"]) for r in now.collect()}
    assert got == {"p1": ("new", 7, None), "p2": ("other", 7, 8)}
    assert {r["project"]: r["embedding"] for r in then.collect()} == {"p1": None, "p2": one_hot(1, 3)}
    again, _ = R.remembered(now, then, {"project": "p1", "key": "k", "content": "newer"})
    assert {r["project"]: r["token_saved"] for r in again.collect()} == {"p1": 7, "p2": 7}
    found = R.recall(m, "p1", "nothing", v, query(spark, one_hot(1, 3))).collect()
    assert [(r["content"]) for r in found] == ["old"]  # its own vector, not the one of p2


def test_vectors_without_a_cosine_are_not_ranked(spark):
    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, None]), ("e", [nan, 1.0]), ("f", [1.0, 0.0, 0.0]), ("g", [0.0, 1.0])]
    m = memory(spark, [(k, "text", [], "p", e) for k, e in rows])
    assert {r["key"] for r in R.knn_ranked(m, vectors(m), "p", query(spark, [1.0, 1.0])).collect()} == {"a", "g"}
    for q in ([0.0, 0.0], None, [nan, 1.0]):
        got = R.recall(m, "p", "text", vectors(m), spark.createDataFrame([(q,)], "qvec array<double>"), 3).collect()
        assert len(got) == 3  # by text alone
