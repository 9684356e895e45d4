"""Line-range patches as set operations, and line diffs.

A patch replaces line ranges (hunks) of a file. It is applied as a whole or not at all: kept lines are those that no
hunk covers, replacement lines take the place of their hunk's first line, and both are put in order again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quern.functions.text import split_lines

#: A repeated read is sent as a diff if both texts are at most so long and less than this share of lines changed.
DIFF_BYTES, DIFF_SHARE = 500_000, 0.20
#: Bytes of rows whose scripts a worker holds at a time, about.
SLICE = 1 << 20
#: For so long an agent is thought to remember what it has read.
TTL_SECONDS = 300


def overlaps(hunks: DataFrame) -> DataFrame:
    """hunks (id, start, end, ...) with overlap: the one before it by start reaches into it."""
    before = F.max("end").over(W.partitionBy("id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    return hunks.withColumn("overlap", F.coalesce(before >= F.col("start"), F.lit(False)))


def _checked(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, text, known, r): one row per file that has hunks; r: its lines, its hunks by start, and the first error.

    Hunks of a file are gathered (they are one patch) and meet its text in one join; the rest are expressions of a row.
    """
    given = F.col("seq") if "seq" in hunks.columns else F.lit(0)
    hunk = F.struct("start", "end", given.alias("seq"), *(["content"] if "content" in hunks.columns else []))
    patches = hunks.groupBy("id").agg(F.sort_array(F.collect_list(hunk)).alias("hunks"))
    rows = patches.join(files.select("id", "text", F.lit(True).alias("known")), "id", "left")

    def error(lines: Column, h: Column) -> Column:
        kinds = (("start below 1", h["start"] < 1), ("end beyond file", h["end"] > F.size(lines)), ("start after end", h["start"] > h["end"]))
        return F.coalesce(*[F.when(test, F.struct(h["seq"].alias("seq"), h["start"].alias("start"), h["end"].alias("end"), F.lit(name).alias("name"))) for name, test in kinds])

    def found(lines: Column) -> Column:
        first = F.array_min(F.filter(F.transform("hunks", lambda h: error(lines, h)), lambda e: e.isNotNull()))["name"]
        ends, starts = F.col("hunks.end"), F.col("hunks.start")
        overlap = F.exists(F.sequence(F.lit(1), F.size("hunks") - 1), lambda i: F.get(ends, i - 1) >= F.get(starts, i))
        overlap = F.when(F.size("hunks") > 1, overlap).otherwise(F.lit(False))
        # fixed value: "Hunks overlap"
        name = F.when(~F.coalesce("known", F.lit(False)), "no such file").when(first.isNotNull(), first).when(overlap, "Hunks overlap")
        return F.struct(lines.alias("lines"), name.alias("error"))

    # the lines are bound to a variable, as each use would cut the text again
    bound = F.transform(F.array(F.coalesce(split_lines(F.col("text")), F.array().cast("array<string>"))), found)[0]
    return rows.withColumn("r", bound)


def validated(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, error): what is wrong with each file's hunks, null if nothing is.

    files: id, text. The first hunk that fails (by seq if hunks have one, else by start and end) says why: a start below
    1, an end beyond the file, a start beyond the end. If none does, overlaps do. Hunks of a file that is not there fail.
    """
    return _checked(files, hunks).select("id", F.col("r.error").alias("error"))


def patched(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, status, lines_changed, text) of files that have hunks (id, start, end, content).

    Files with an invalid hunk come back unchanged, with the error as status; a file that is not there has no text.
    lines_changed counts the lines that were replaced. Empty content deletes; an end of line at the file's end stays.
    """
    rows, lines = _checked(files, hunks), F.col("r.lines")
    before = lambda i: F.when(i > 0, F.get(F.col("hunks.end"), i - 1)).otherwise(F.lit(0))
    new = lambda h: F.when(h["content"] == "", F.array().cast("array<string>")).otherwise(split_lines(h["content"]))
    pieces = F.transform("hunks", lambda h, i: F.concat(F.slice(lines, before(i) + 1, h["start"] - before(i) - 1), new(h)))
    last = F.element_at("hunks.end", -1)
    put = F.concat(F.flatten(pieces), F.slice(lines, last + 1, F.size(lines) - last))
    end = F.when(F.col("text").endswith("\n") & (F.size(put) > 0), "\n").otherwise("")
    good = F.col("r.error").isNull()
    changed = F.aggregate("hunks", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"] + 1)
    return rows.select(
        "id", F.coalesce("r.error", F.lit("ok")).alias("status"), F.when(good, changed).otherwise(F.lit(0)).cast("long").alias("lines_changed"),
        F.when(good, F.concat(F.array_join(put, "\n"), end)).otherwise(F.col("text")).alias("text"),
    )


def _cut(text: str) -> list[str]:
    """Lines with their ends; other characters that end lines elsewhere are part of a line here."""
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def _middle(a: list, b: list) -> tuple[int, int, int, int]:
    """A run of equal items in the middle of a shortest script: its start and end in a and in b (a0, b0, a1, b1).

    Searches go along diagonals from both ends until they meet; each keeps one point a diagonal, so memory is linear.
    """
    n, m = len(a), len(b)
    delta, ways = n - m, ({1: 0}, {1: 0})
    for edits in range((n + m + 1) // 2 + 1):
        for back, own, other in ((0, *ways), (1, ways[1], ways[0])):
            for d in range(-edits + 2 * max(0, edits - m), edits - 2 * max(0, edits - n) + 1, 2):
                down = d == -edits or (d != edits and own.get(d - 1, -1) < own.get(d + 1, -1))
                x = begin = own[d + 1] if down else own[d - 1] + 1
                y = x - d
                while x < n and y < m and (a[n - 1 - x] == b[m - 1 - y] if back else a[x] == b[y]):
                    x, y = x + 1, y + 1
                own[d] = x
                reach = edits if back else edits - 1
                if delta % 2 != back and -reach <= delta - d <= reach and delta - d in other and x + other[delta - d] >= n:
                    return (n - x, m - y, n - begin, m - (begin - d)) if back else (begin, begin - d, x, y)
    raise AssertionError("two searches that never meet")


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by dividing at middle runs."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, j, k, l = open_.pop()
        while i < j and k < l and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < l and a[j - 1] == b[l - 1]:
            j, l = j - 1, l - 1
            found.append((j, l))
        if i < j and k < l:
            x, y, u, v = _middle(a[i:j], b[k:l])
            found += [(i + x + t, k + y + t) for t in range(u - x)]
            open_ += [(i, i + x, k, k + y), (i + u, j, k + v, l)]
    return sorted(found)


def edit_script(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """A shortest script of (sign, line), signs " ", "-" and "+"; where lines are replaced the old ones come first.

    Lines that only one side has are no part of the search, whose memory is linear in the rest.
    """
    common = set(old) & set(new)
    at_old, at_new = ([i for i, x in enumerate(xs) if x in common] for xs in (old, new))
    out, i, k = [], 0, 0
    for p, q in [*((at_old[x], at_new[y]) for x, y in _matches([old[x] for x in at_old], [new[y] for y in at_new])), (len(old), len(new))]:
        out += [("-", x) for x in old[i:p]] + [("+", x) for x in new[k:q]] + [(" ", x) for x in old[p : p + 1]]
        i, k = p + 1, q + 1
    return out


def diff(old: str | None, new: str | None) -> tuple[float, str]:
    """(share of changed lines in the script, the script as text); nulls count as empty."""
    script = edit_script(_cut(old or ""), _cut(new or ""))
    changes = sum(sign != " " for sign, _ in script)
    return (changes / len(script) if script else 0.0), "".join(sign + line for sign, line in script)


def _sliced(batch) -> Iterator:
    """An Arrow batch in slices of about SLICE bytes, one row at least."""
    step = max(1, SLICE * len(batch) // max(1, batch.nbytes))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def with_diff(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows with ratio and diff of two text columns, computed in Arrow batches."""
    schema = T.StructType([*rows.schema.fields, T.StructField("ratio", T.DoubleType()), T.StructField("diff", T.StringType())])
    i, j = rows.columns.index(old), rows.columns.index(new)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in _sliced(whole):
                found = [diff(x.as_py(), y.as_py()) for x, y in zip(batch.column(i), batch.column(j))]
                more = [pa.array([r for r, _ in found], pa.float64()), pa.array([t for _, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "ratio", "diff"])

    return rows.mapInArrow(run, schema)


def since_last_read(reads: DataFrame, seconds: int = TTL_SECONDS) -> DataFrame:
    """reads (agent_id, file, seq, ts, content) with mode and sent: a diff to the agent's last read of the file, or all.

    A diff is sent if there was a read before, at most so many seconds ago, both texts have at most DIFF_BYTES, and some but less than DIFF_SHARE
    of the lines changed. Only such pairs go through the diff.
    """
    order = W.partitionBy("agent_id", "file").orderBy("seq")
    fresh = F.lag("ts").over(order) >= F.col("ts") - F.expr(f"interval {seconds} seconds")
    rows = reads.withColumn("previous", F.when(fresh, F.lag("content").over(order)))
    fits = F.col("previous").isNotNull() & (F.octet_length("previous") <= DIFF_BYTES) & (F.octet_length("content") <= DIFF_BYTES) & (F.col("previous") != F.col("content"))
    fits = F.coalesce(fits, F.lit(False))
    compared = with_diff(rows.filter(fits), "previous", "content")
    small = F.col("ratio") < DIFF_SHARE
    compared = compared.withColumn("mode", F.when(small, "diff").otherwise("full")).withColumn("sent", F.when(small, F.col("diff")).otherwise(F.col("content")))
    rest = rows.filter(~fits).withColumn("mode", F.lit("full")).withColumn("sent", F.col("content"))
    keep = [*reads.columns, "mode", "sent"]
    return compared.select(*keep).unionByName(rest.select(*keep))
