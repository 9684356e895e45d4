from collections import Counter

from quern.operators import code as C
from quern.operators import patch as P
from quern.plans import registry
from tests.conftest import DATA

LANGUAGES = {"rs": "rust", "py": "python"}


def rows(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


def test_code_in_prose_and_odd_texts(spark):
    """Over every document as a file of its own kind: what plain functions say of each text."""
    from quern.plans import views

    files = views.files(spark, DATA).select("path", "text")
    texts = {r["path"]: r["text"] for r in files.collect()}
    langs = {p: LANGUAGES.get(p.rsplit(".", 1)[-1]) for p in texts}
    want = Counter((p, d.name, t.count("\n", 0, d.start) + 1, d.kind) for p, t in texts.items() if langs[p] for d in C.definitions(t, langs[p]))
    assert Counter(map(tuple, C.symbols(files).collect())) == want
    for mode in ("full", "skeleton", "compressed"):
        assert {r["path"]: r["sent"] for r in C.with_reads(files, mode).collect()} == {p: C.read(p, t, langs[p], mode) for p, t in texts.items()}


def test_a_refresh_parses_changed_files_alone(spark):
    kind = "path string, text string"
    old = [(f"f{i}.rs", f"fn a{i}() {{}}\n") for i in range(40)] + [("none.rs", "// x\n"), ("gone.py", "def g(): pass\n"), ("null.go", None)]
    new = [(p, t) for p, t in old if p != "gone.py"]
    new[3], new[7] = ("f3.rs", "fn b() {}\nfn c() {}\n"), ("f7.rs", "")
    new += [("more.rs", "struct S;\n"), ("text.txt", "fn no() {}\n")]
    index = C.indexed(spark.createDataFrame(old, kind))
    files = spark.createDataFrame(new, kind)
    assert {r["path"] for r in C.changed_files(index, files).collect()} == {"f3.rs", "f7.rs", "more.rs"}
    rows = lambda df: sorted(map(repr, df.collect()))
    after = C.refreshed(index, files)
    assert rows(after) == rows(C.indexed(files))
    assert rows(C.refreshed(after, files)) == rows(after) and C.changed_files(after, files).count() == 0


def test_every_turn_is_compared_with_the_one_before(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    last, want = {}, {}
    for r in sorted(turns, key=lambda r: r["turn"]):
        old = last.get((r["role"], r["conv_id"]), "")
        want[r["role"], r["conv_id"], r["turn"]] = P.diff(old, r["text"])[1]
        assert want[r["role"], r["conv_id"], r["turn"]] or old == r["text"]
        last[r["role"], r["conv_id"]] = r["text"]
    assert {(r["role"], r["conv_id"], r["turn"]): r["diff"] for r in rows(spark, "turn_diff")} == want


def test_stems_of_the_whole_corpus(spark):
    stems = rows(spark, "analyze_stems")
    assert sum(r["times"] for r in stems) == sum(r["times"] for r in rows(spark, "analyze_tokens"))
    assert len(stems) == len({r["stem"] for r in stems}) > 100
