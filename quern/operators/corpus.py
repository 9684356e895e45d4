"""Scans over a corpus of text files: lines, grep, trees, paths, guards."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.text import extension, safe_truncate, split_lines, trimmed

# Directories that scans leave out, and the one more that listings do.
NOISE = ("node_modules", "target", ".git", ".next", "dist", "__pycache__", ".turbo", "build")
LISTING_NOISE = (*NOISE, "vendor")
# Extensions of text files.
TEXT_EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "py", "go", "toml", "yaml", "yml", "json", "md", "txt", "sh", "sql", "html", "css", "env", "lock")
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go"}
GREP_BYTES, INDEX_BYTES, PATTERN_BYTES, MATCHES = 1_000_000, 1_048_576, 1024, 50
LISTING_BYTES, DEPTH, DEEPEST = 10_000, 2, 20
#: What a match in a line can have that the whole file has not: ends of the text, looks around, flags, possessive parts.
_OWN_LINE = re.compile(r"\\[AzZG]|\(\?(?!:)|[*+?}]\+")


def scan(spark: SparkSession, folder: str, most: int = GREP_BYTES) -> DataFrame:
    """(path, length, text) of a folder's files outside noise directories and up to most bytes.

    The size is tested on the listing, before any content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.filter(F.col("length") <= most).filter(unpruned(F.col("path")))
    return files.select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def unpruned(path: Column, noise: Sequence[str] = NOISE) -> Column:
    """No directory of the path is noise (its last segment is the file)."""
    segments = F.split(path, "/")
    folders = F.slice(segments, 1, F.size(segments) - 1)
    return ~F.arrays_overlap(folders, F.array(*map(F.lit, noise)))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob for whole paths and all that lies below them.

    ``*`` and ``?`` stay within a segment, ``**`` stands for any number of segments, ``[a-z]`` and ``[!a-z]`` for a character,
    ``{a,b}`` for either, also nested; a backslash takes the next character as it is. A glob without a slash (a last one aside) matches at any
    depth, others from the root on. Raises ValueError for a brace or bracket that is not closed.
    """
    body = glob.strip("/")
    out, depth, i = "" if "/" in body or glob.startswith("/") else "(?:.*/)?", 0, 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if body.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            end = body.find("]", i + 2)
            if end < 0:
                raise ValueError(f"a bracket is not closed: {glob}")
            inner = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + ("[^/" + inner[1:] if inner[0] in "!^" else "[" + inner) + "]", end + 1
            continue
        if c == "\\" and i + 1 < len(body):
            i += 1
            out += re.escape(body[i])
        elif c in "{}":
            depth += 1 if c == "{" else -1
            out += "(?:" if c == "{" else ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        if depth < 0:
            break
        i += 1
    if depth:
        raise ValueError(f"a brace is not closed: {glob}")
    return f"^{out}(?:/.*)?$"


def chosen(path: Column, rules: Sequence[str]) -> Column:
    """Whether ordered rules choose the path: the last glob that matches it, or a directory it lies in, decides.

    A rule that starts with ``!`` leaves out. What no rule matches is chosen unless some rule chooses. One expression in the JVM, from
    the last rule to the first; a null path is not chosen.
    """
    verdict = F.lit(all(r.startswith("!") for r in rules))
    for rule in rules:
        verdict = F.when(path.rlike(glob_pattern(rule.removeprefix("!"))), F.lit(not rule.startswith("!"))).otherwise(verdict)
    return F.coalesce(path.isNotNull() & verdict, F.lit(False))


def is_text(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def language(path: Column) -> Column:
    """Language by extension; null for any other."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return known[extension(path)]


def lines(files: DataFrame) -> DataFrame:
    """files with their lines: line (from 1) and text, one row each."""
    keep = [c for c in files.columns if c != "text"]
    out = files.select(*keep, F.posexplode(split_lines(F.col("text"))).alias("line", "text"))
    return out.withColumn("line", F.col("line") + 1)


def matches(files: DataFrame, pattern: str, ignore_case: bool = True, glob: str | None = None) -> DataFrame:
    """(path, line, text) of every line that the pattern matches, text trimmed.

    A glob chooses files as one of ``chosen``'s rules. Where a match in a line must be one in the file too, files are tested
    as a whole first, so only files with matches are cut into lines.
    """
    if len(pattern.encode()) > PATTERN_BYTES:
        raise ValueError(f"a pattern has at most {PATTERN_BYTES} bytes")
    flags = "(?iu)" if ignore_case else ""
    files = files.filter(F.octet_length("text") <= GREP_BYTES)
    if glob is not None:
        files = files.filter(chosen(F.col("path"), [glob]))
    if not _OWN_LINE.search(pattern):
        files = files.filter(F.col("text").rlike(f"(?m){flags}{pattern}"))
    found = lines(files.select("path", "text")).filter(F.col("text").rlike(flags + pattern))
    return found.withColumn("text", trimmed(F.col("text")))


def grep(files: DataFrame, pattern: str, ignore_case: bool = True, glob: str | None = None, most: int = MATCHES) -> DataFrame:
    """The first most matches by path and line."""
    return matches(files, pattern, ignore_case, glob).orderBy("path", "line").limit(most)


def grouped(found: DataFrame) -> DataFrame:
    """(path, n_matches, shown): matches of a file as one text, in line order."""
    shown = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda m: F.concat(F.lit("  "), m["line"].cast("string"), F.lit(": "), m["text"]))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n_matches"), F.array_join(shown, "\n").alias("shown"))


def tree(paths: DataFrame, depth: int = DEPTH, noise: Sequence[str] = LISTING_NOISE, root: str | None = None) -> DataFrame:
    """(path, depth, is_dir, entry): every file and directory down to depth (at most 20), without noise directories and
    what they hold; a file may have such a name.

    paths: column path. A path that others continue is a directory. Of a root only what lies below it, named from there;
    one that holds nothing is an error.
    """
    if root is not None:
        inside = paths.filter(F.col("path").startswith(root.rstrip("/") + "/"))
        if inside.limit(1).count() == 0:
            raise ValueError(f"no such directory: {root}")
        paths = inside.select(F.substring("path", len(root.rstrip("/")) + 2, 1 << 30).alias("path"))
    parts = F.split("path", "/")
    found = F.filter(F.transform(F.array(*map(F.lit, noise)), lambda x: F.array_position(F.slice(parts, 1, F.size(parts) - 1), x)), lambda k: k > 0)
    last = F.least(F.coalesce(F.array_min(found) - 1, F.size(parts)), F.lit(min(depth, DEEPEST))).cast("int")
    kept = paths.withColumn("__last", last).filter("__last > 0")
    prefix = F.transform(F.sequence(F.lit(1), F.col("__last")), lambda i: F.struct(F.slice(parts, 1, i).alias("p"), (i < F.size(parts)).alias("is_dir")))
    every = kept.select(F.explode(prefix).alias("x")).select("x.p", "x.is_dir")
    every = every.groupBy(F.array_join("p", "/").alias("path"), F.size("p").alias("depth"), F.element_at("p", -1).alias("name")).agg(F.bool_or("is_dir").alias("is_dir"))
    # An entry is two spaces for each level, a sign, a slash for directories, and the name.
    mark = F.when(F.col("is_dir"), F.lit("📁/ ")).otherwise(F.lit("📄 "))
    return every.select("path", "depth", "is_dir", F.concat(F.expr("repeat('  ', depth)"), mark, "name").alias("entry"))


def listing(entries: DataFrame, most: int = LISTING_BYTES, root: str = ".") -> DataFrame:
    """One row: the root and the entries of ``tree``, a line each in path order, cut to most bytes.

    Only the entries that the text can hold are gathered: none is shorter than two bytes with its end of line.
    """
    first = entries.orderBy("path").limit(most // 2 + 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "entry"))), lambda x: x["entry"]), "\n")
    lines = F.concat_ws("\n", F.lit(f"📂 {root}"), F.nullif("t", F.lit("")), F.lit(""))
    return first.agg(text.alias("t")).select(safe_truncate(lines, most).alias("listing"))


def resolved(path: Column) -> Column:
    """The path without empty, "." and ".." parts and without a slash at its end; "/" for the root. Null, for which no
    guard opens, if a relative path leaves the folder that it starts from."""
    absolute = path.startswith("/")
    climbed = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).when(absolute, acc)
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", climbed(acc)).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def under(path: Column, root: Column) -> Column:
    """path is root or lies below it; /a/bc is not below /a/b."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def allowed(paths: DataFrame, roots: DataFrame, deny_without_roots: bool = True) -> DataFrame:
    """paths with ``allowed``: some root of (root) holds it. Without roots nothing is allowed, unless said otherwise.
    Paths and roots are resolved first; links are not followed, as there are no files to ask.

    Each path asks for its own ancestors, so this is an equality join of paths' prefixes with roots, not a
    comparison of all with all.
    """
    if not deny_without_roots and roots.limit(1).count() == 0:
        return paths.withColumn("allowed", F.lit(True))
    known = roots.select(resolved(F.col("root")).alias("root")).distinct()
    path = resolved(F.col("path"))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    first = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(first, F.array_join(F.slice(parts, F.lit(1), i), "/")))
    hit = paths.select("path", F.explode(above).alias("root")).join(known, "root", "left_semi")
    hit = hit.select("path").distinct().withColumn("__hit", F.lit(True))
    return paths.join(hit, "path", "left").withColumn("allowed", F.coalesce("__hit", F.lit(False))).drop("__hit")


def project_root(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, root): the nearest ancestor of each path that is in markers (root); null if none is."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = paths.select("path", F.explode(above).alias("root")).join(markers.select("root").distinct(), "root")
    nearest = found.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(nearest, "path", "left")


def invalidated(changed: DataFrame, keys: DataFrame) -> DataFrame:
    """Cache keys (key, kind, path) that a change of files (path) makes stale.

    Reads of the file itself in any mode, and searches below a directory that holds the file.
    """
    reads = keys.filter("kind = 'read'").join(changed.select("path").distinct(), "path", "left_semi")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    roots = changed.select(F.explode(above).alias("path")).distinct()
    searches = keys.filter("kind = 'search'").join(roots, "path", "left_semi")
    return reads.unionByName(searches)


def collapse_blank_lines(files: DataFrame) -> DataFrame:
    """Lines (path, line, text) without those that are blank after a blank one."""
    before = F.lag(F.col("text")).over(W.partitionBy("path").orderBy("line"))
    rows = lines(files).withColumn("__before", before)
    return rows.filter(~((trimmed(F.col("text")) == "") & F.coalesce(trimmed(F.col("__before")) == "", F.lit(False)))).drop("__before")


def inject_standards(files: DataFrame, everywhere: Sequence[str], by_extension: dict[str, Sequence[str]], cards: dict[str, str]) -> DataFrame:
    """files with ``out``: the text, followed by the rules for all files and for its extension, and by the cards whose
    trigger word stands in it. Nothing is added where nothing applies."""
    rule = lambda xs: "\n".join(f"- {x}" for x in xs)
    pieces = [F.lit(rule(everywhere))] if everywhere else []
    for ext, rules in by_extension.items():
        pieces.append(F.when(extension(F.col("path")) == ext, F.lit(rule(rules))))
    for trigger, card in cards.items():
        pieces.append(F.when(F.contains(F.col("text"), F.lit(trigger)), F.lit(card)))
    added = F.concat_ws("\n", *pieces)
    return files.withColumn("out", F.when(added == "", F.col("text")).otherwise(F.concat("text", F.lit("\n\n"), added)))


