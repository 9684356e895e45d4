"""Patch and diff queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import split_lines
from quern.operators import patch as P
from quern.plans import views as V



def _documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _hunks(spark, sf_dir):
    long_enough = _documents(spark, sf_dir).filter(F.size(split_lines(F.col("text"))) >= 3)
    content = F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("patched-"), "id"))
    return long_enough.select("id", F.lit(2).alias("start"), F.lit(3).alias("end"), content.alias("content"))


def apply_hunks(spark, sf_dir):
    out = P.patched(_documents(spark, sf_dir), _hunks(spark, sf_dir))
    return out.select("id", "status", "lines_changed", F.sha2("text", 256).alias("text_sha256"))


def hunk_validate(spark, sf_dir):
    """Hunks of every document, each with the kind of error that its id says; a fifth have none."""
    kind = F.col("id") % 5
    start = F.when(kind == 0, 0).otherwise(1)
    end = F.when(kind == 1, 10_000_000).when(kind == 2, 0).otherwise(1)
    hunks = _documents(spark, sf_dir).select("id", start.alias("start"), end.alias("end"), F.lit("x").alias("content"))
    return P.validated(_documents(spark, sf_dir), hunks.unionByName(hunks.filter(kind == 3)))


def hunk_overlap(spark, sf_dir):
    """Shipping and quantity ranges of an order's lines as hunks."""
    l = V.table(spark, sf_dir, "lineitem")
    hunks = l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + F.col("l_partkey") % 2).cast("int").alias("end"))
    return P.overlaps(hunks).groupBy("id").agg(F.count_if("overlap").alias("n_overlaps"))


def _edited(text: F.Column, id_: F.Column) -> F.Column:
    """A text with one change by its number: the first line gone, its second replaced, a line at its end, none, or another text."""
    lines = F.split(text, "\n")
    mark = F.concat(F.lit("edit "), id_.cast("string"))
    kind = id_ % 5
    return (
        F.when(kind == 0, F.array_join(F.slice(lines, 2, F.size(lines)), "\n"))
        .when(kind == 1, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(mark), F.slice(lines, 3, F.size(lines))), "\n"))
        .when(kind == 2, F.concat(text, F.lit("\n"), mark)).when(kind == 3, text).otherwise(mark)
    )


def diff_since_last_read(spark, sf_dir):
    """Each document is read three times: as it is, edited soon after, and edited again, of every third document too late."""
    d = _documents(spark, sf_dir)
    edited = _edited(F.col("text"), F.col("id"))
    again = F.concat(edited, F.lit("\nagain"))
    late = F.when(F.col("id") % 3 == 0, 1_000).otherwise(200)
    read = lambda seq, content, at: F.struct(F.lit(seq).alias("seq"), content.alias("content"), at.alias("at"))
    three = d.select("id", F.inline(F.array(read(0, F.col("text"), F.lit(0)), read(1, edited, F.lit(100)), read(2, again, 100 + late))))
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, at)")
    reads = three.select(F.concat(F.lit("agent-"), F.col("id") % 7).alias("agent_id"), F.col("id").alias("file"), "seq", "content", ts.alias("ts"))
    return P.since_last_read(reads).select("agent_id", "file", "seq", "mode", F.octet_length("sent").cast("long").alias("sent_bytes"), F.sha2("sent", 256).alias("sent_sha256"))


def previous_reads(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    before = F.lag("text").over(P.W.partitionBy("role", "conv_id").orderBy("turn"))
    return c.select("role", "conv_id", "turn", F.octet_length(before).alias("previous_bytes"), (before == F.col("text")).alias("same"))


def line_diff(spark, sf_dir):
    """Of each document, whole, and the same with a change."""
    pairs = _documents(spark, sf_dir).withColumn("new", _edited(F.col("text"), F.col("id")))
    return P.with_diff(pairs, "text", "new").select("id", F.round("ratio", 9).alias("ratio"), F.sha2("diff", 256).alias("diff_sha256"))


def turn_diff(spark, sf_dir):
    """Of each turn and the turn of the same role before it, whole; the first one's is against nothing."""
    c = V.table(spark, sf_dir, "conversations")
    before = F.lag("text").over(P.W.partitionBy("role", "conv_id").orderBy("turn"))
    pairs = c.select("role", "conv_id", "turn", F.coalesce(before, F.lit("")).alias("old"), F.col("text").alias("new"))
    return P.with_diff(pairs, "old", "new").select("role", "conv_id", "turn", "diff")


def diff_ratio(spark, sf_dir):
    """Of each document and itself with one more line: its last line, which gets an end, and the new one change."""
    pairs = _documents(spark, sf_dir).select("id", "text", F.concat("text", F.lit("\nend")).alias("new"))
    return P.with_diff(pairs, "text", "new").select("id", F.round("ratio", 9).alias("ratio"))


QUERIES = {f.__name__: f for f in (apply_hunks, hunk_validate, hunk_overlap, diff_since_last_read, previous_reads, line_diff, turn_diff, diff_ratio)}

# Scripts by hand: lines with their ends and signs. A text's last line has an end once another follows it. Of equal lines
# in a row, of which one goes, the last goes: run says how many there are from the line that changes.
_EDITED = """e AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS p, 'edit ' || doc_id AS mark FROM documents),
    n AS (SELECT *, len(p) AS size, CASE id % 5 WHEN 0 THEN array_to_string(p[2:], chr(10)) WHEN 1 THEN array_to_string(list_concat(list_concat(p[:1], [mark]), p[3:]), chr(10))
                  WHEN 2 THEN text || chr(10) || mark WHEN 3 THEN text ELSE mark END AS changed FROM e),
    c AS (SELECT *, [' ' || x FOR x IN p] AS same, ['-' || x FOR x IN p] AS gone,
                 coalesce(list_min([j FOR j IN range(id % 5 + 2, size + 1) IF p[j] <> p[id % 5 + 1] OR j = size]) - id % 5 - 1, 1) AS run FROM n),
    s AS (SELECT *, CASE id % 5
        WHEN 0 THEN CASE WHEN size = 1 THEN gone[1] ELSE array_to_string(list_concat(list_concat(same[:run - 1], gone[run:run]), same[run + 1:]), chr(10)) END
        WHEN 1 THEN CASE WHEN size = 1 THEN gone[1] || '+' || p[1] || chr(10) || '+' || mark
                         WHEN size = 2 THEN same[1] || chr(10) || gone[2] || '+' || mark
                         WHEN run = 1 THEN array_to_string(list_concat([same[1], gone[2], '+' || mark], same[3:]), chr(10))
                         ELSE array_to_string(list_concat(list_concat([same[1], '+' || mark], same[2:run]), list_concat(gone[run + 1:run + 1], same[run + 2:])), chr(10)) END
        WHEN 2 THEN array_to_string(list_concat(same[:-2], [gone[-1]]), chr(10)) || '+' || p[-1] || chr(10) || '+' || mark
        WHEN 3 THEN array_to_string(same, chr(10))
        ELSE array_to_string(gone, chr(10)) || '+' || mark END AS script,
        CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN size = 1 THEN 3 ELSE 2 END WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE size + 1 END AS changes,
        CASE id % 5 WHEN 0 THEN size WHEN 1 THEN CASE WHEN size = 1 THEN 3 ELSE size + 1 END WHEN 2 THEN size + 2 WHEN 3 THEN size ELSE size + 1 END AS lines FROM c)"""
_AGAIN = """a AS (SELECT *, string_split(changed, chr(10)) AS q FROM s),
    t AS (SELECT *, array_to_string(list_concat([' ' || x FOR x IN q[:-2]], ['-' || q[-1]]), chr(10)) || '+' || q[-1] || chr(10) || '+again' AS script2, len(q) AS size2 FROM a)"""

ORACLE_SQL = {
    "apply_hunks": """WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS p FROM documents WHERE len(string_split(text, chr(10))) >= 3)
        SELECT id, 'ok' AS status, CAST(2 AS BIGINT) AS lines_changed,
               sha256(array_to_string(list_concat(p[:1], list_concat(CASE WHEN id % 5 = 0 THEN [] ELSE ['patched-' || id] END, p[4:])), chr(10))) AS text_sha256 FROM l""",
    "hunk_validate": """SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'start below 1' WHEN 1 THEN 'end beyond file'
        WHEN 2 THEN 'start after end' WHEN 3 THEN 'Hunks overlap' END AS error FROM documents""",
    "hunk_overlap": """WITH h AS (SELECT l_orderkey AS id, l_linenumber AS s, l_linenumber + l_partkey % 2 AS e FROM lineitem),
        w AS (SELECT id, coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s, false) AS o FROM h)
        SELECT id, CAST(count_if(o) AS BIGINT) AS n_overlaps FROM w GROUP BY id""",
    "previous_reads": """WITH w AS (SELECT role, conv_id, turn, text, lag(text) OVER (PARTITION BY role, conv_id ORDER BY turn) AS b FROM conversations)
        SELECT role, conv_id, turn, CAST(strlen(b) AS INTEGER) AS previous_bytes, b = text AS same FROM w""",
    "line_diff": f"WITH {_EDITED} SELECT id, round(CAST(changes AS DOUBLE) / lines, 9) AS ratio, sha256(script) AS diff_sha256 FROM s",
    "diff_since_last_read": f"""WITH {_EDITED}, {_AGAIN}, r AS (
        SELECT id, 0 AS seq, false AS small, text AS content, '' AS script FROM t
        UNION ALL SELECT id, 1, changed <> text AND changes < {P.DIFF_SHARE} * lines AND greatest(strlen(text), strlen(changed)) <= {P.DIFF_BYTES}, changed, script FROM t
        UNION ALL SELECT id, 2, id % 3 <> 0 AND changed <> '' AND 3 < {P.DIFF_SHARE} * (size2 + 2) AND strlen(changed || chr(10) || 'again') <= {P.DIFF_BYTES}, changed || chr(10) || 'again', script2 FROM t)
        SELECT 'agent-' || (id % 7) AS agent_id, id AS file, seq, CASE WHEN small THEN 'diff' ELSE 'full' END AS mode,
               CAST(strlen(CASE WHEN small THEN script ELSE content END) AS BIGINT) AS sent_bytes, sha256(CASE WHEN small THEN script ELSE content END) AS sent_sha256 FROM r""",
    "diff_ratio": """SELECT doc_id AS id, round(CAST(3 AS DOUBLE) / (len(string_split(text, chr(10))) + 2), 9) AS ratio FROM documents""",
}
