"""Definitions, skeletons and comment-free text of source files, without a grammar.

A file is masked first: comments and strings become blanks of the same length, so that brackets and words in them
mean nothing. Definitions are then found at bracket depth 0, where a statement starts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import extension
from quern.operators.corpus import INDEX_BYTES, language, scan
from quern.sources.scratch import Scratch

NO_DEFINITIONS = "// nothing is defined at the top level\n"
NO_OUTLINE = "// no outline for files of this kind; the whole text follows\n"

_TOKENS = {
    "rust": r"""(?P<c>//[^\n]*|/\*)|(?P<s>b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^'\\\n])')""",
    "typescript": r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)""",
    "go": r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`)""",
    "python": r"""(?P<c>\#[^\n]*)|(?P<s>\"{3}(?:\\.|.)*?\"{3}|'{3}(?:\\.|.)*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')""",
}
_TOKENS = {k: re.compile(v, re.S) for k, v in _TOKENS.items()}
_BOUNDS = re.compile(r"/\*|\*/")


def spans(text: str, lang: str) -> Iterator[tuple[str, int, int]]:
    """("c" or "s", start, end) of comments and strings; block comments of Rust nest."""
    at = 0
    while m := _TOKENS[lang].search(text, at):
        start, at = m.span()
        kind = "c" if m["c"] else "s"
        if m[0] == "/*":
            depth = 1
            while depth and (b := _BOUNDS.search(text, at)):
                depth, at = depth + (1 if b[0] == "/*" else -1), b.end()
            at = at if not depth else len(text)
        yield kind, start, at


def masked(text: str, lang: str) -> str:
    out, last = [], 0
    for _, start, end in spans(text, lang):
        out += [text[last:start], re.sub(r"[^\n]", " ", text[start:end])]
        last = end
    return "".join(out) + text[last:]


def strip_comments(text: str, lang: str) -> str:
    """The text without comments; of blank lines in a row one stays, and the final end of line goes."""
    out, last = [], 0
    for kind, start, end in spans(text, lang):
        if kind == "c":
            out.append(text[last:start])
            last = end
    lines = ("".join(out) + text[last:]).split("\n")
    lines = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]
    kept = [x for x, before in zip(lines, [None, *lines]) if x.strip() or before is None or before.strip()]
    return "\n".join(kept)


@dataclass(frozen=True)
class Definition:
    kind: str
    name: str
    start: int
    body: int | None
    end: int


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    name: Callable[[re.Match], str]
    #: how the definition ends: with its block, at a semicolon, or with its line
    ends: str
    has_body: bool = True


def _rule(kind: str, pattern: str, name=lambda m: m["n"], ends: str = "block", has_body: bool = True) -> Rule:
    return Rule(kind, re.compile(pattern, re.S), name, ends, has_body)


_ANON = lambda m: "anonymous"
_PUB = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_RULES = {
    "rust": [
        _rule("function_item", _PUB + r"(?:(?:default|const|async|unsafe|extern(?:\s+\S+)?)\s+)*fn\s+(?P<n>\w+)"),
        _rule("struct_item", _PUB + r"struct\s+(?P<n>\w+)"),
        _rule("enum_item", _PUB + r"enum\s+(?P<n>\w+)"),
        _rule("trait_item", _PUB + r"(?:unsafe\s+)?trait\s+(?P<n>\w+)"),
        _rule("type_item", _PUB + r"type\s+(?P<n>\w+)", ends=";", has_body=False),
        _rule("const_item", _PUB + r"const\s+(?P<n>\w+)\s*:", ends=";", has_body=False),
        _rule("static_item", _PUB + r"static\s+(?:mut\s+)?(?P<n>\w+)", ends=";", has_body=False),
        _rule("use_declaration", _PUB + r"use\s+(?P<n>[\w:]+)\s*;", ends=";", has_body=False),
        _rule("use_declaration", _PUB + r"use\b", _ANON, ";", False),
        _rule("", _PUB + r"(?:unsafe\s+)?(?:impl|mod)\b"),
    ],
    "typescript": [
        _rule("export_statement", r"export\b", _ANON, "any", False),
        _rule("function_declaration", r"(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)"),
        _rule("class_declaration", r"class\s+(?P<n>[\w$]+)"),
        _rule("interface_declaration", r"interface\s+(?P<n>[\w$]+)", has_body=False),
        _rule("enum_declaration", r"enum\s+(?P<n>[\w$]+)", has_body=False),
        _rule("type_alias_declaration", r"type\s+(?P<n>[\w$]+)", ends=";", has_body=False),
        _rule("lexical_declaration", r"(?:const|let)\b", _ANON, ";", False),
    ],
    "go": [
        _rule("method_declaration", r"func\s*\([^)]*\)\s*(?P<n>\w+)"),
        _rule("function_declaration", r"func\s+(?P<n>\w+)"),
        _rule("type_declaration", r"type\b", _ANON, "line", False),
        _rule("var_declaration", r"var\b", _ANON, "line", False),
        _rule("const_declaration", r"const\b", _ANON, "line", False),
    ],
}
_OPEN, _CLOSE = "([{", ")]}"


def _close(mask: str, at: int) -> int:
    """Position after the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(mask)):
        if mask[i] in _OPEN:
            depth += 1
        elif mask[i] in _CLOSE:
            depth -= 1
            if depth == 0:
                return i + 1
    return len(mask)


def _end(mask: str, at: int, ends: str) -> tuple[int | None, int]:
    """(start of the block or None, end) of a statement whose head ends at ``at``."""
    i = at
    while i < len(mask):
        c = mask[i]
        if c == "{" and ends in ("block", "any"):
            return i, _close(mask, i)
        if c in _OPEN:
            i = _close(mask, i)
            continue
        if c == ";" or (c == "\n" and ends == "line") or (c == "\n" and ends in (";", "any") and _line_ends(mask, i)):
            return None, i + (c == ";")
        i += 1
    return None, len(mask.rstrip())


@lru_cache(maxsize=2)
def _places(text: str, pattern: str) -> list[int]:
    """Where matches of a pattern start."""
    return [m.start() for m in re.finditer(pattern, text)]


def _row(text: str, at: int) -> int:
    """The line, from 0, that holds a place."""
    return bisect_left(_places(text, "\n"), at)


def _line_ends(mask: str, at: int) -> bool:
    """Whether a statement without semicolon ends at a line end."""
    solid = _places(mask, r"\S")
    k = bisect_left(solid, at)
    before, after = mask[solid[k - 1]] if k else "", mask[solid[k]] if k < len(solid) else ""
    return before not in "=,+-*/|&<>?:(" and after not in ".=+-*/|&?:,)]}" if before and after else True


def _python(text: str, mask: str) -> Iterator[Definition]:
    rows = list(re.finditer(r"^.*$", mask, re.M))
    strings = [s for k, s, _ in spans(text, "python") if k == "s"]
    tops, depth = [], 0
    for m in rows:  # lines that start a statement in the first column
        if depth == 0 and m[0][:1].strip() and m[0][0] not in ")]}":
            tops.append(m.start())
        depth += sum(m[0].count(c) for c in _OPEN) - sum(m[0].count(c) for c in _CLOSE)
    decorated = None
    for start, after in zip(tops, [*tops[1:], len(mask)]):
        end = start + len(mask[start:after].rstrip())
        m = re.compile(r"(?:async\s+)?def\s+(?P<d>\w+)|class\s+(?P<c>\w+)|@").match(mask, start)
        if m and m[0] == "@":
            decorated = start if decorated is None else decorated
        elif m and decorated is not None:
            yield Definition("decorated_definition", "anonymous", decorated, None, end)
            decorated = None
        elif m:
            i = m.end()
            while i < end and mask[i] != ":":
                i = _close(mask, i) if mask[i] in _OPEN else i + 1
            gap = re.compile(r"\s*").match(mask, i + 1).end()
            # a docstring is masked, but it is the body's first statement
            k = bisect_right(strings, i)
            first = min(strings[k], end) if k < len(strings) else end
            yield Definition("function_definition" if m["d"] else "class_definition", m["d"] or m["c"], start, min(gap, first), end)


def definitions(text: str, lang: str) -> list[Definition]:
    """Top-level definitions in order; what stands inside other definitions, impl blocks and modules is not top-level."""
    mask = masked(text, lang)
    if lang == "python":
        return list(_python(text, mask))
    found, at = [], 0
    while at < len(mask):
        c = mask[at]
        if c.isspace() or c in ";}":
            at += 1
            continue
        if lang == "rust" and mask.startswith("#", at):  # an attribute belongs to no definition
            bracket = mask.find("[", at)
            at = _close(mask, bracket) if bracket >= 0 else len(mask)
            continue
        for rule in _RULES[lang]:
            if m := rule.pattern.match(mask, at):
                head = m.end() - 1 if mask[m.end() - 1] == ";" else m.end()
                body, end = _end(mask, head, rule.ends)
                if rule.kind:
                    found.append(Definition(rule.kind, rule.name(m), at, body if rule.has_body else None, end))
                at = max(end, at + 1)
                break
        else:
            _, end = _end(mask, at, "any")
            at = max(end, at + 1)
    return found


def signature(text: str, lines: list[str], d: Definition) -> str:
    """Lines of a definition up to the one before its body; the first line if the body starts there."""
    first, last = _row(text, d.start), _row(text, max(d.start, d.end - 1))
    if d.body is not None:
        last = max(first, _row(text, d.body) - 1)
    return "\n".join(lines[first : last + 1]).rstrip() or lines[first]


def skeleton(text: str, lang: str) -> str:
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    parts = [f"// L{_row(text, d.start) + 1}\n{signature(text, lines, d)}\n\n" for d in definitions(text, lang)]
    return "".join(parts) or NO_DEFINITIONS


def read(path: str, text: str, lang: str | None, mode: str) -> str:
    """What a read of a file in a mode sends: the text, its skeleton or the text without comments."""
    if mode == "skeleton":
        # fixed value: the first line of a skeleton
        n = text.count("\n") + (not text.endswith("\n") and bool(text))
        return f"// skeleton of {path} ({n} lines total)\n\n{skeleton(text, lang)}" if lang else NO_OUTLINE + text
    if mode == "compressed" and lang:
        return strip_comments(text, lang)
    return text


def _mapped(rows: DataFrame, added: list[T.StructField], values: Callable, many: bool = False) -> DataFrame:
    """rows (path, text, ...) with columns from values(path, text, language), or with a row for each of many."""
    rows = rows.withColumn("__lang", language(F.col("path")))
    i, j, k = (rows.columns.index(c) for c in ("path", "text", "__lang"))
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            found = [values(*x) for x in zip(*(batch.column(c).to_pylist() for c in (i, j, k)))]
            if many:
                batch = batch.take(pa.array([r for r, xs in enumerate(found) for _ in xs], pa.int64()))
                found = [x for xs in found for x in xs]
            new = [pa.array([x[c] for x in found], kinds.field(f.name).type) for c, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=kinds)

    return rows.mapInArrow(run, schema).drop("__lang")


def tasks(spark: SparkSession) -> int:
    """Tasks that files to parse are dealt to, whatever the size of their table: that number is not made smaller by adaptive execution."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_reads(files: DataFrame, mode: str) -> DataFrame:
    """files (path, text) with sent and saved (bytes that were not sent); a null text counts as empty."""
    if mode not in ("full", "skeleton", "compressed"):
        raise ValueError(f"a read is full, skeleton or compressed, not {mode}")
    out = _mapped(files, [T.StructField("sent", T.StringType())], lambda p, t, lang: (read(p, t or "", lang, mode),))
    saved = F.greatest(F.lit(0), F.octet_length("text") - F.octet_length("sent")).cast("long")
    known = extension(F.col("path")).isin("rs", "ts", "tsx", "py", "go")
    return out.withColumn("saved", F.when(known & F.lit(mode != "full"), saved).otherwise(F.lit(0).cast("long")))


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, line, kind) of all top-level definitions; other files than source files have none."""
    added = [T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("kind", T.StringType())]

    def values(path: str, text: str | None, lang: str | None) -> list[tuple]:
        text = text or ""
        return [(d.name, _row(text, d.start) + 1, d.kind) for d in definitions(text, lang)] if lang else []

    return _mapped(files, added, values, many=True).select("path", "name", "line", "kind")


def symbol_index(found: DataFrame) -> DataFrame:
    """(name, path, line, kind, n_places): the places of each name, a row each, with how many there are. Files are parsed once."""
    found = Scratch(found.sparkSession, "symbols").table(found)
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("n_places"))
    return found.join(counts, "name").select("name", "path", "line", "kind", "n_places")


def find_symbol(found: DataFrame, name: str) -> DataFrame:
    return found.filter(F.col("name") == name)


def _hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def indexed(files: DataFrame) -> DataFrame:
    """(path, sha, name, line, kind) of files (path, text): a row per definition; a file without any has one without a name."""
    known = language(F.col("path")).isNotNull()
    rows = _hashed(files.filter(known).select("path", "text"))
    added = [T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("kind", T.StringType())]

    def values(path: str, text: str | None, lang: str) -> list[tuple]:
        text = text or ""
        return [(d.name, _row(text, d.start) + 1, d.kind) for d in definitions(text, lang)] or [(None, None, None)]

    return _mapped(rows, added, values, many=True).select("path", "sha", "name", "line", "kind")


def changed_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """files (path, text) that the index (``indexed``) does not know with this content; only paths and hashes meet."""
    known = index.select("path", "sha").distinct()
    return _hashed(files.filter(language(F.col("path")).isNotNull())).join(known, ["path", "sha"], "left_anti").select("path", "text")


def refreshed(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index of files now: only changed and new files are parsed, rows of files that are gone or changed go.

    Paths are unique in files. The result is ``indexed(files)``, and the next refresh's index once it is written.
    """
    now = _hashed(files.select("path", "text")).select("path", "sha")
    changed = changed_files(index, files).repartition(tasks(files.sparkSession), "path")
    return index.join(now, ["path", "sha"], "left_semi").unionByName(indexed(changed))


def project_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, line, kind) of a folder's source files of at most INDEX_BYTES, noise directories left out."""
    files = scan(spark, folder, INDEX_BYTES)
    return symbols(files.filter(language(F.col("path")).isNotNull()).select("path", "text"))
