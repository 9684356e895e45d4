"""Source-code queries over files that the parts make: one file per part, in four languages and as plain text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import code as C
from quern.plans import views as V
from quern.sources.scratch import Scratch

# Files by p_partkey % 5: path, head, then p_size % 4 + 1 functions, tail. {k} is the part's key, {s} its size, {n} its name,
# {t} its type, {i} a function's number. Comments and strings hold brackets that mean nothing.
FILES = (
    ("src/part_{k}.rs", "// {n} {\nuse std::fmt;\npub struct Part{k} {\n    size: u32, /* { /* nested */ } */\n}\n", 'pub fn step_{i}(\n    part: u32,\n) -> u32 {\n    let s = "// {{ {t}";\n    part + {i} // } more\n}\n', "/* fn gone() {} */"),
    ("tool/part_{k}.py", "# {n} (\nimport os\n\n", 'def step_{i}(\n    part,\n    size={i},\n):\n    """Of # {t}."""\n    return part + size  # :\n\n\n', "class Part{k}:\n    size = {s} # {\n"),
    ("cmd/part_{k}.go", "package main // {n}\n\nvar size = {s} // {\n\n", "func (p *Part) step_{i}(a int) int {\n\treturn a + {i}\n}\n", "/* { */\n"),
    ("web/part_{k}.ts", "export const size = {s};\nclass Part{k} {\n  v = '{';\n}\n", "function step_{i}(x: number): number {\n  return x; // {t} {\n}\n", ""),
    ("notes/part_{k}.txt", "{n}\n", "// {t} {i}\n", "fn step_1() {}\n"),
)


def _filled(template: str, number=None) -> F.Column:
    out = F.lit(template)
    for mark, value in (("{k}", F.col("p_partkey")), ("{s}", F.col("p_size")), ("{n}", F.col("p_name")), ("{t}", F.col("p_type")), ("{i}", number)):
        if value is not None and mark in template:
            out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def _by_kind(values: list[F.Column]) -> F.Column:
    kind = F.col("p_partkey") % len(values)
    out = F.when(kind == 0, values[0])
    for n, value in enumerate(values[1:], 1):
        out = out.when(kind == n, value)
    return out


def _files(spark, sf_dir):
    # parsing a file takes far longer than reading its row, and such a table may be one split
    part = V.table(spark, sf_dir, "part").repartition(C.tasks(spark), "p_partkey")
    numbers = F.sequence(F.lit(1), F.col("p_size") % 4 + 1)
    steps = lambda f: F.array_join(F.transform(numbers, lambda i: _filled(f, i)), "")
    text = [F.concat(_filled(head), steps(f), _filled(tail)) for _, head, f, tail in FILES]
    return part.select(_by_kind([_filled(p) for p, *_ in FILES]).alias("path"), _by_kind(text).alias("text"))


def symbol_rows(spark, sf_dir):
    return C.symbols(_files(spark, sf_dir))


def symbol_index(spark, sf_dir):
    return C.symbol_index(C.symbols(_files(spark, sf_dir)))


def find_symbol(spark, sf_dir, name="step_3"):
    return C.find_symbol(C.symbols(_files(spark, sf_dir)), name)


def symbol_refresh(spark, sf_dir):
    """The index after a change: before it every seventh file had another text, every eleventh was missing, and others were there that are gone."""
    now = _files(spark, sf_dir)
    n = F.regexp_extract("path", r"_(\d+)\.", 1).cast("long")
    gone = now.filter(n % 13 == 0).withColumn("path", F.concat(F.lit("old/"), "path"))
    changed = F.when(n % 7 == 0, F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))
    before = now.filter(n % 11 != 0).withColumn("text", changed).unionByName(gone)
    index = Scratch(spark, "symbols").table(C.indexed(before))
    return C.refreshed(index, now).filter("name is not null").select("path", "name", "line", "kind")


def skeleton(spark, sf_dir):
    return C.with_reads(_files(spark, sf_dir), "skeleton").select("path", "sent")


def strip_comments(spark, sf_dir):
    return C.with_reads(_files(spark, sf_dir), "compressed").select("path", "sent")


def read_modes(spark, sf_dir):
    modes = [C.with_reads(_files(spark, sf_dir), m).select("path", F.lit(m).alias("mode"), F.octet_length("sent").cast("long").alias("sent_bytes"), "saved") for m in ("full", "skeleton", "compressed")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


QUERIES = {f.__name__: f for f in (symbol_rows, symbol_index, find_symbol, symbol_refresh, skeleton, strip_comments, read_modes)}

# What the files define, by kind: (name, line, kind) before the functions, line of the first function, lines of one, its kind,
# and (name, lines after the functions, kind) after them.
_DEFINED = (
    ([("std::fmt", 2, "use_declaration"), ("Part{k}", 3, "struct_item")], 6, 6, "function_item", []),
    ([], 4, 8, "function_definition", [("Part{k}", 0, "class_definition")]),
    ([("anonymous", 3, "var_declaration")], 5, 3, "method_declaration", []),
    ([("anonymous", 1, "export_statement"), ("Part{k}", 2, "class_declaration")], 5, 3, "function_declaration", []),
)
# Skeletons, as FILES; {r} is a function's line, {e} the line after the functions, {l} the number of lines.
_SKELETONS = (
    ("// skeleton of src/part_{k}.rs ({l} lines total)\n\n// L2\nuse std::fmt;\n\n// L3\npub struct Part{k} {\n\n", "// L{r}\npub fn step_{i}(\n    part: u32,\n\n", ""),
    ("// skeleton of tool/part_{k}.py ({l} lines total)\n\n", "// L{r}\ndef step_{i}(\n    part,\n    size={i},\n):\n\n", "// L{e}\nclass Part{k}:\n\n"),
    ("// skeleton of cmd/part_{k}.go ({l} lines total)\n\n// L3\nvar size = {s} // {\n\n", "// L{r}\nfunc (p *Part) step_{i}(a int) int {\n\n", ""),
    ("// skeleton of web/part_{k}.ts ({l} lines total)\n\n// L1\nexport const size = {s};\n\n// L2\nclass Part{k} {\n\n", "// L{r}\nfunction step_{i}(x: number): number {\n\n", ""),
    ("// no outline for files of this kind; the whole text follows\n{n}\n", "// {t} {i}\n", "fn step_1() {}\n"),
)
# Texts without comments.
_BARE = (
    ("\nuse std::fmt;\npub struct Part{k} {\n    size: u32, \n}\n", 'pub fn step_{i}(\n    part: u32,\n) -> u32 {\n    let s = "// {{ {t}";\n    part + {i} \n}\n', ""),
    ("\nimport os\n\n", 'def step_{i}(\n    part,\n    size={i},\n):\n    """Of # {t}."""\n    return part + size  \n\n', "class Part{k}:\n    size = {s} "),
    ("package main \n\nvar size = {s} \n\n", "func (p *Part) step_{i}(a int) int {\n\treturn a + {i}\n}\n", "\n"),
    ("export const size = {s};\nclass Part{k} {\n  v = '{';\n}\n", "function step_{i}(x: number): number {\n  return x; \n}\n", ""),
    ("{n}\n", "// {t} {i}\n", "fn step_1() {}\n"),
)


def _sql(template: str, kind: int = 0) -> str:
    first, step = _DEFINED[kind][1:3] if kind < len(_DEFINED) else (2, 1)
    extra = (2, 2, 1, 0, 1)[kind] if kind != 0 else 1
    end = f"({first} + {step} * m)"
    values = {"{k}": "p_partkey", "{s}": "p_size", "{n}": "p_name", "{t}": "p_type", "{i}": "i", "{r}": f"({first} + {step} * (i - 1))", "{e}": end, "{l}": f"({end} - 1 + {extra})"}
    out = "'" + template.replace("'", "''") + "'"
    for mark, value in values.items():
        if mark in template:
            out = f"replace({out}, '{mark}', CAST({value} AS VARCHAR))"
    return out


def _case(texts: list[str]) -> str:
    return f"CASE p_partkey % {len(texts)} " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(texts)) + " END"


def _texts(files: tuple, trimmed: bool = False) -> str:
    """trimmed: without the last end of line, where the file is of a known language."""
    whole = [f"{_sql(h, n)} || array_to_string(list_transform(range(1, m + 1), lambda i: {_sql(f, n)}), '') || {_sql(t, n)}" for n, (h, f, t) in enumerate(files)]
    return _case([f"regexp_replace({x}, '\\n$', '')" if trimmed and n < len(_DEFINED) else x for n, x in enumerate(whole)])


_PARTS = "f AS (SELECT *, p_size % 4 + 1 AS m FROM part)"
_PATH = _case([_sql(p) for p, *_ in FILES])
_READS = f"""{_PARTS}, x AS (SELECT {_PATH} AS path, p_partkey % 5 = 4 AS plain, {_texts([x[1:] for x in FILES])} AS whole, {_texts(_SKELETONS)} AS outline, {_texts(_BARE, True)} AS bare FROM f)"""


def _defined() -> str:
    parts = []
    for n, (before, first, step, kind, after) in enumerate(_DEFINED):
        rows = [(_sql(name), str(line), k, "f") for name, line, k in before] + [(_sql(name), f"{first} + {step} * m + {line}", k, "f") for name, line, k in after]
        rows.append(("'step_' || i", f"{first} + {step} * (i - 1)", kind, "(SELECT *, unnest(range(1, m + 1)) AS i FROM f)"))
        parts += [f"SELECT {_sql(FILES[n][0])} AS path, {name} AS name, CAST({line} AS INTEGER) AS line, '{k}' AS kind FROM {source} WHERE p_partkey % 5 = {n}" for name, line, k, source in rows]
    return f"{_PARTS}, v AS (" + " UNION ALL ".join(parts) + ")"


_SYMBOLS = _defined()
ORACLE_SQL = {
    "symbol_rows": f"WITH {_SYMBOLS} SELECT path, name, line, kind FROM v",
    "symbol_index": f"WITH {_SYMBOLS} SELECT name, path, line, kind, count(*) OVER (PARTITION BY name) AS n_places FROM v",
    "find_symbol": f"WITH {_SYMBOLS} SELECT path, name, line, kind FROM v WHERE name = 'step_3'",
    "symbol_refresh": f"WITH {_SYMBOLS} SELECT path, name, line, kind FROM v",
    "skeleton": f"WITH {_READS} SELECT path, outline AS sent FROM x",
    "strip_comments": f"WITH {_READS} SELECT path, CASE WHEN plain THEN whole ELSE bare END AS sent FROM x",
    "read_modes": f"""WITH {_READS}, r AS (SELECT path, plain, whole, 'full' AS mode, whole AS sent FROM x
        UNION ALL SELECT path, plain, whole, 'skeleton', outline FROM x UNION ALL SELECT path, plain, whole, 'compressed', CASE WHEN plain THEN whole ELSE bare END FROM x)
        SELECT path, mode, CAST(strlen(sent) AS BIGINT) AS sent_bytes, CAST(CASE WHEN plain OR mode = 'full' THEN 0 ELSE greatest(0, strlen(whole) - strlen(sent)) END AS BIGINT) AS saved FROM r""",
}
