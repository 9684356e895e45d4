import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.text import safe_truncate, split_lines, trimmed
from quern.operators import code as K
from quern.operators import corpus as C
from quern.operators import patch as P


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")


def test_lines(spark):
    got = [r[0] for r in texts(spark, "a\r\nb\n", "", "x", "\n\n", None).orderBy("id").select(split_lines(F.col("text"))).collect()]
    assert got == [["a", "b"], [], ["x"], ["", ""], None]
    assert texts(spark, "  a b \t ").select(trimmed(F.col("text"))).first()[0] == "a b"


def test_truncation_ends_between_characters(spark):
    cut = lambda s, n: texts(spark, s).select(safe_truncate(F.col("text"), n)).first()[0]
    assert cut("aé", 3) == "aé"
    assert cut("aéb", 2) == "a\n... [output truncated]"
    assert cut("😀😀", 5) == "😀\n... [output truncated]"


def test_scan_and_grep_of_a_folder(spark, tmp_path):
    for name, text in {"src/a.rs": "fn Main() {}\n  main \nx", "node_modules/a.rs": "main", "src/big.md": "main" * 10, "b.bin": "MAIN"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = C.scan(spark, str(tmp_path), 30)
    assert {r["path"].rpartition("/")[2] for r in files.collect()} == {"a.rs", "b.bin"}
    found = [(r["path"].rpartition("/")[2], r["line"], r["text"]) for r in C.grep(files, "main").collect()]
    assert sorted(found) == [("a.rs", 1, "fn Main() {}"), ("a.rs", 2, "main"), ("b.bin", 1, "MAIN")]
    assert C.grep(files, "main", ignore_case=False).count() == 1
    assert C.grep(files, "^x$", glob="**/*.rs").count() == 1
    assert C.grep(files, r"Main\(\) \{\}\Z", ignore_case=False).count() == 1
    assert C.grep(files, r"(?<![\s\S])  main").count() == 1
    with pytest.raises(ValueError):
        C.grep(files, "x" * 1025)


def test_trees(spark):
    names = ["a/build", "a/build.rs/x", "a/target/y/z", "a/b/c/d", "vendor/q", "a/b/e"]
    paths = spark.createDataFrame([(x,) for x in names], "path string")
    shown = lambda **k: C.listing(C.tree(paths, **k), root=k.get("root", ".")).first()[0]
    assert shown(depth=9) == "📂 .\n  📁/ a\n    📁/ b\n      📁/ c\n        📄 d\n      📄 e\n    📄 build\n    📁/ build.rs\n      📄 x\n"
    assert shown(depth=1, root="a") == "📂 a\n  📁/ b\n  📄 build\n  📁/ build.rs\n"
    with pytest.raises(ValueError, match="no such directory"):
        C.tree(paths, root="missing")


def test_guard_is_closed_without_roots(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a/b",)], "path string")
    roots = spark.createDataFrame([("/a/b",)], "root string")
    allowed = lambda r, **k: {x["path"] for x in C.allowed(paths, r, **k).collect() if x["allowed"]}
    assert allowed(roots) == {"/a/b/c", "/a/b"}
    odd = ["/a/b/../../etc/passwd", "/a/b/./c/../d/", "/a//b/x", "/a/x/../b", "a/b", "/..", None, ""]
    odd_paths = spark.createDataFrame([(x,) for x in odd], "path string")
    opened = lambda root: {x["path"] for x in C.allowed(odd_paths, spark.createDataFrame([(root,)], "root string")).collect() if x["allowed"]}
    assert opened("/a/b") == opened("/a/./b/") == opened("//a/c/../b//") == {"/a/b/./c/../d/", "/a//b/x", "/a/x/../b"}
    assert opened("/") == {x for x in odd if x and x.startswith("/")}
    assert opened("../x") == set()
    assert allowed(roots.limit(0)) == set()
    assert len(allowed(roots.limit(0), deny_without_roots=False)) == 3


HUNKS = "id long, start int, end int, content string"


def test_overlapping_hunks_are_refused(spark):
    files = texts(spark, "ash\nbirch\ncedar\nelm\nfir\noak\npine")
    got = P.patched(files, spark.createDataFrame([(0, 5, 6, "yew"), (0, 1, 5, "")], HUNKS)).first()
    assert (got["status"], got["lines_changed"]) == ("Hunks overlap", 0) and got["text"].endswith("fir\noak\npine")


def test_the_first_failing_hunk_says_why(spark):
    files = texts(spark, "a\nb\n", None)
    seen = lambda rows, kind=HUNKS: {r["id"]: r["error"] for r in P.validated(files, spark.createDataFrame(rows, kind)).collect()}
    assert seen([(0, 2, 999, ""), (0, 3, 2, ""), (9, 1, 1, "x"), (1, 1, 1, "")]) == {0: "end beyond file", 9: "no such file", 1: "end beyond file"}
    assert seen([(0, 1, 999, "", 1), (0, 0, 1, "", 2)], HUNKS + ", seq int") == {0: "end beyond file"}
    got = P.patched(files, spark.createDataFrame([(9, 1, 1, "x")], HUNKS)).first()
    assert (got["status"], got["lines_changed"], got["text"]) == ("no such file", 0, None)


def test_hunks_replace_insert_and_delete(spark):
    files = texts(spark, "a\nb\nc\nd\n", "a\nb", "a\n")
    hunks = spark.createDataFrame([(0, 1, 1, "x\ny"), (0, 3, 4, ""), (1, 2, 2, "z"), (2, 1, 1, "")], "id long, start int, end int, content string")
    got = {r["id"]: (r["status"], r["lines_changed"], r["text"]) for r in P.patched(files, hunks).collect()}
    assert got[0] == ("ok", 3, "x\ny\nb\n") and got[1] == ("ok", 1, "a\nz") and got[2][0] == "ok"


lines = st.lists(st.sampled_from("abc"), max_size=9)


@given(lines, lines)
@settings(max_examples=300, suppress_health_check=list(HealthCheck))
def test_scripts_are_right_and_shortest(a, b):
    script = P.edit_script(a, b)
    assert [x for s, x in script if s != "+"] == a and [x for s, x in script if s != "-"] == b
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
    assert sum(s != " " for s, _ in script) == len(a) + len(b) - 2 * common[-1][-1]


def test_long_files_need_little_memory():
    import tracemalloc

    old, new = [f"{i % 97} {i}" for i in range(6000)], [f"{i % 89} {i}" for i in range(6000)]
    shuffled = [f"line {i * 37 % 500}" for i in range(500)]
    tracemalloc.start()
    assert len(P.edit_script(old, new)) > 6000
    P.edit_script(sorted(shuffled), shuffled)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_ratio_of_a_long_file():
    old = [f"line {i}" for i in range(1000)]
    new = [x if i % 10 else f"{x} changed" for i, x in enumerate(old)]
    assert P.diff("\n".join(old), "\n".join(new))[0] == 200 / 1100
    assert P.diff(None, "") == (0.0, "")


def test_a_repeated_read_is_sent_as_a_diff(spark):
    base = [f"line {i}" for i in range(30)]
    changed = ["new"] + base[1:]
    rows = [("a", "f", 1, "\n".join(base)), ("a", "f", 2, "\n".join(changed)), ("a", "f", 3, "\n".join(changed)), ("b", "f", 4, "x"), ("a", "f", 5, "all new")]
    late = [("c", "f", 6, "\n".join(base)), ("c", "f", 20, "\n".join(changed))]
    df = spark.createDataFrame(rows + late, "agent_id string, file string, seq long, content string")
    df = df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq * 25)"))
    got = {r["seq"]: (r["mode"], r["sent"]) for r in P.since_last_read(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "full", 2: "diff", 3: "full", 4: "full", 5: "full", 6: "full", 20: "full"}
    assert got[2][1].startswith("-line 0\n+new\n line 1")


@pytest.mark.parametrize("lang", ["rust", "typescript", "python", "go"])
@given(st.text(alphabet="fn struct{}()[]\"'/*#\n@:def class;x`\\ ", max_size=60))
@settings(max_examples=150, suppress_health_check=list(HealthCheck), deadline=None)
def test_any_text_can_be_parsed(lang, text):
    assert len(K.masked(text, lang)) == len(text)
    K.skeleton(text, lang)
    K.strip_comments(text, lang)
    assert all(0 <= d.start < d.end <= len(text) for d in K.definitions(text, lang))


def test_unknown_mode_and_null_text(spark):
    files = spark.createDataFrame([("a.rs", None), ("b", "x // y")], "path string, text string")
    with pytest.raises(ValueError):
        K.with_reads(files, "other")
    assert [r["sent"] for r in K.with_reads(files, "compressed").orderBy("path").collect()] == ["", "x // y"]
    assert K.symbols(files).collect() == []


def test_symbols_of_a_folder(spark, tmp_path):
    for name, text in {"src/a.rs": "fn one() {}\n", "target/b.rs": "fn two() {}\n", "c.py": "def three(): pass\n", "d.md": "fn four() {}", "big.go": "func five() {}\n" + " " * K.INDEX_BYTES}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["name"] for r in K.project_symbols(spark, str(tmp_path)).collect()} == {"one", "three"}


def test_long_files_are_parsed_in_proportion():
    import time

    def seconds(n, lang, unit):
        text = "".join(unit % k for k in range(n))
        began = time.process_time()
        assert len(K.definitions(text, lang)) == n
        K.skeleton(text, lang)
        return time.process_time() - began

    for lang, unit in (("typescript", "const a%d = f(x)\n\n"), ("python", "def f%d(x):\n    'd'\n    return x\n")):
        seconds(500, lang, unit)
        assert seconds(16_000, lang, unit) < 30 * max(0.03, seconds(2_000, lang, unit))


def test_globs_and_ordered_rules(spark):
    paths = ["src/a.rs", "src/deep/er/b.ts", "a.rs", "lib/x.rs", "src/gen/c.rs", "src/gen/keep.rs", "docs/read me.md", "w[1].txt", "src", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    chosen = lambda *rules: {r["path"] for r in df.filter(C.chosen(F.col("path"), list(rules))).collect()}
    assert chosen("src/**") == {"src/a.rs", "src/deep/er/b.ts", "src/gen/c.rs", "src/gen/keep.rs"}
    assert chosen("*.{rs,ts}") == {"src/a.rs", "src/deep/er/b.ts", "a.rs", "lib/x.rs", "src/gen/c.rs", "src/gen/keep.rs"}
    assert chosen("/*.rs") == {"a.rs"} and chosen("**/er/*") == {"src/deep/er/b.ts"}
    assert chosen("{src/{a,z},lib/*}.r[!a-q]") == {"src/a.rs", "lib/x.rs"}
    assert chosen("src/**/*.rs", "!gen", "src/gen/keep.rs") == {"src/a.rs", "src/gen/keep.rs"}
    assert chosen("!src") == {"a.rs", "lib/x.rs", "docs/read me.md", "w[1].txt"}
    assert chosen("w\\[1\\].*") == {"w[1].txt"} and chosen("read?me.md") == {"docs/read me.md"}
    for bad in ("{a", "a}", "[a"):
        with pytest.raises(ValueError):
            C.glob_pattern(bad)

