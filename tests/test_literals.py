"""Operators on literal inputs whose rows were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quern.functions.stemming import stems
from quern.functions.text import folded_tokens
from quern.operators import code as C
from quern.operators import patch as P
from tests.conftest import DATA
from tests.oracle import agree, connect

# Invented source files, one per language, and a text file.
SOURCES = [
    ("src/shape.rs", "use std::fmt;\n// a { b\npub struct Point {\n    x: i32,\n}\n\n\n/* c /* d */ e */\npub fn area(\n    w: u32,\n) -> u32 {\n    w * 2\n}\nimpl Point {\n    fn inner() {}\n}\n"),
    ("web/box.ts", "export const a = 1;\nfunction add(x: number): number {\n  return x; // sum\n}\nclass Box {\n  v = '{';\n}\n"),
    ("tool/run.py", 'import os\n\n@cached\ndef load(p):\n    return p  # path\n\nclass Job:\n    """Runs."""\n\ndef main(): return 0\n'),
    ("cmd/main.go", "package main\n\nvar n = 1 // count\n\nfunc (j *Job) Run(a int) int {\n\treturn a\n}\n\nfunc main() {\n}\n"),
    ("notes.txt", "plain text\n"),
]


def _sources(spark):
    return spark.createDataFrame(SOURCES, "path string, text string")


def symbol_rows(spark):
    return C.symbols(_sources(spark))


def symbol_index(spark):
    return C.symbol_index(C.symbols(_sources(spark)))


def find_symbol(spark):
    return C.symbols(_sources(spark)).filter(F.col("name") == "main")


def skeleton(spark):
    out = C.with_reads(_sources(spark), "skeleton")
    return out.select("path", F.replace("sent", F.lit("\n"), F.lit("~")).alias("sent"))


def strip_comments(spark):
    out = C.with_reads(_sources(spark), "compressed")
    return out.select("path", F.replace("sent", F.lit("\n"), F.lit("~")).alias("sent"))


def read_modes(spark):
    modes = [C.with_reads(_sources(spark), m).select("path", F.lit(m).alias("mode"), F.octet_length("sent").cast("long").alias("sent_bytes"), "saved") for m in ("full", "skeleton", "compressed")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


HUNKS = "id long, start int, end int, content string"
#: Hunks with every kind of error, on documents of any length of at least a line.
INVALID = [(1, 0, 1, "x"), (2, 1, 10_000_000, "x"), (3, 1, 0, "x"), (4, 1, 1, "x"), (4, 1, 1, "y"), (5, 1, 1, "fine")]


def hunk_validate(spark):
    files = spark.createDataFrame([(k, "a\nb\n") for k in range(1, 6)], "id long, text string")
    return P.validated(files, spark.createDataFrame(INVALID, HUNKS))


PAIRS = [(1, "a\nb\nc\n", "a\nx\nc\n"), (2, "", "new\n"), (3, "same\n", "same\n"), (4, "a\nb\n", ""), (5, "a\nb", "a\nb\n")]


def line_diff(spark):
    return P.with_diff(spark.createDataFrame(PAIRS, "id long, old string, new string"), "old", "new").select("id", "diff")


STEM_WORDS = "Consistency consigned running hopping happy skies relational generously knightly national easily controlling agreed 42"


def analyze_stems(spark):
    t = spark.createDataFrame([(STEM_WORDS,)], "content string")
    return t.select(F.posexplode(stems(folded_tokens(F.col("content")))).alias("place", "stem"))


_SYMBOLS = """v(path, name, line, kind) AS (VALUES
    ('src/shape.rs', 'std::fmt', 1, 'use_declaration'), ('src/shape.rs', 'Point', 3, 'struct_item'), ('src/shape.rs', 'area', 9, 'function_item'),
    ('web/box.ts', 'anonymous', 1, 'export_statement'), ('web/box.ts', 'add', 2, 'function_declaration'), ('web/box.ts', 'Box', 5, 'class_declaration'),
    ('tool/run.py', 'anonymous', 3, 'decorated_definition'), ('tool/run.py', 'Job', 7, 'class_definition'), ('tool/run.py', 'main', 10, 'function_definition'),
    ('cmd/main.go', 'anonymous', 3, 'var_declaration'), ('cmd/main.go', 'Run', 5, 'method_declaration'), ('cmd/main.go', 'main', 9, 'function_declaration'))"""
_FULL = "(VALUES " + ", ".join(f"('{p}', {len(t.encode())})" for p, t in SOURCES) + ") f(path, size)"
_SKELETON = """s(path, sent) AS (VALUES
    ('src/shape.rs', '// skeleton of src/shape.rs (16 lines total)~~// L1~use std::fmt;~~// L3~pub struct Point {~~// L9~pub fn area(~    w: u32,~~'),
    ('web/box.ts', '// skeleton of web/box.ts (7 lines total)~~// L1~export const a = 1;~~// L2~function add(x: number): number {~~// L5~class Box {~~'),
    ('tool/run.py', '// skeleton of tool/run.py (10 lines total)~~// L3~@cached~def load(p):~    return p  # path~~// L7~class Job:~~// L10~def main(): return 0~~'),
    ('cmd/main.go', '// skeleton of cmd/main.go (10 lines total)~~// L3~var n = 1 // count~~// L5~func (j *Job) Run(a int) int {~~// L9~func main() {~~'),
    ('notes.txt', '// no outline for files of this kind; the whole text follows~plain text~'))"""
_STRIPPED = """c(path, sent) AS (VALUES
    ('src/shape.rs', 'use std::fmt;~~pub struct Point {~    x: i32,~}~~pub fn area(~    w: u32,~) -> u32 {~    w * 2~}~impl Point {~    fn inner() {}~}'),
    ('web/box.ts', 'export const a = 1;~function add(x: number): number {~  return x; ~}~class Box {~  v = ''{'';~}'),
    ('tool/run.py', 'import os~~@cached~def load(p):~    return p  ~~class Job:~    \"\"\"Runs.\"\"\"~~def main(): return 0'),
    ('cmd/main.go', 'package main~~var n = 1 ~~func (j *Job) Run(a int) int {~' || chr(9) || 'return a~}~~func main() {~}'),
    ('notes.txt', 'plain text~'))"""

WANTED = {
    "symbol_rows": f"WITH {_SYMBOLS} SELECT path, name, CAST(line AS INTEGER) AS line, kind FROM v",
    "symbol_index": f"WITH {_SYMBOLS} SELECT name, path, CAST(line AS INTEGER) AS line, kind, count(*) OVER (PARTITION BY name) AS n_places FROM v",
    "find_symbol": f"WITH {_SYMBOLS} SELECT path, name, CAST(line AS INTEGER) AS line, kind FROM v WHERE name = 'main'",
    "skeleton": f"WITH {_SKELETON} SELECT path, sent FROM s",
    "strip_comments": f"WITH {_STRIPPED} SELECT path, sent FROM c",
    "read_modes": f"""WITH {_SKELETON}, {_STRIPPED}, r AS (
        SELECT path, 'full' AS mode, CAST(size AS BIGINT) AS sent_bytes, size FROM {_FULL}
        UNION ALL SELECT path, 'skeleton', strlen(sent), size FROM s JOIN {_FULL} USING (path)
        UNION ALL SELECT path, 'compressed', strlen(sent), size FROM c JOIN {_FULL} USING (path))
        SELECT path, mode, sent_bytes, CAST(CASE WHEN path = 'notes.txt' OR mode = 'full' THEN 0 ELSE greatest(0, size - sent_bytes) END AS BIGINT) AS saved FROM r""",
    "hunk_validate": """SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'start below 1'), (2, 'end beyond file'), (3, 'start after end'), (4, 'Hunks overlap'), (5, NULL)) t(id, error)""",
    "line_diff": """SELECT id, replace(d, '~', chr(10)) AS diff FROM (VALUES (CAST(1 AS BIGINT), ' a~-b~+x~ c~'), (2, '+new~'), (3, ' same~'), (4, '-a~-b~'), (5, ' a~-b+b~')) t(id, d)""",
    "analyze_stems": """SELECT CAST(p AS INTEGER) AS place, s AS stem FROM (VALUES (0, 'consist'), (1, 'consign'), (2, 'run'), (3, 'hop'), (4, 'happi'), (5, 'sky'),
        (6, 'relat'), (7, 'generous'), (8, 'knight'), (9, 'nation'), (10, 'easili'), (11, 'control'), (12, 'agre'), (13, '42')) t(p, s)""",
}


@pytest.mark.parametrize("name", sorted(WANTED))
def test_literal_inputs_give_their_rows(spark, name):
    agree(globals()[name](spark), connect(DATA), WANTED[name])
