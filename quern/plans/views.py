"""Canonical views over the tables: as DataFrames, and as SQL text (common table expressions) with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, key, embedding) of the records that have a vector."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("project"))
    own = e.join(d, e["vec_id"] == d["doc_id"])
    return own.select("project", F.concat(F.lit("doc-"), "vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed knowledge records, one per document; their vectors stand apart."""
    roi = F.col("doc_id") % 10 == 0
    tags = F.when(roi, F.array("lang", "source", F.lit("roi"))).otherwise(F.array("lang", "source"))
    usage = F.floor(F.col("n_chars") / 4).cast("long")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("key"), F.col("text").alias("content"), tags.alias("tags"), F.col("lang").alias("project"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("created_at"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("agent-"), F.col("doc_id") % 7)).alias("agent_id"),
        usage.alias("token_usage"), F.when(roi, F.floor(usage / 2).cast("long")).alias("token_saved"),
    )


MEMORY = """v_memory AS (
    SELECT 'doc-' || d.doc_id AS key, d.text AS content, d.lang AS project,
           CASE WHEN d.doc_id % 10 = 0 THEN [d.lang, d.source, 'roi'] ELSE [d.lang, d.source] END AS tags,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at,
           CASE WHEN d.doc_id % 7 <> 0 THEN 'agent-' || (d.doc_id % 7) END AS agent_id,
           d.n_chars // 4 AS token_usage, CASE WHEN d.doc_id % 10 = 0 THEN (d.n_chars // 4) // 2 END AS token_saved,
           CAST(e.embedding AS DOUBLE[]) AS embedding
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Savings and usage by agent and project, one row per event; every seventh event has no agent."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).alias("agent_id"), F.col("event_type").alias("project"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("long")).alias("token_saved"), F.get_json_object("props", "$.k").cast("long").alias("token_usage"),
    )


LEDGER = """v_ledger AS (
    SELECT CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS agent_id, event_type AS project, ts AS created_at,
           CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value) AS BIGINT) END AS token_saved,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS token_usage
    FROM events)"""

NOW = "2024-01-31 00:00:00"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text corpus: path and text, one file per document."""
    kind = F.create_map(*[F.lit(x) for pair in (("en", ".md"), ("fr", ".rs"), ("de", ".py"), ("es", ".bin")) for x in pair])
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.coalesce(kind[F.col("lang")], F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")


FILES = """v_files AS (
    SELECT doc_id, text, source || '/' || lang || '/' || doc_id ||
           CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.rs' WHEN 'de' THEN '.py' WHEN 'es' THEN '.bin' ELSE '' END AS path
    FROM documents)"""

#: The same lines as ``functions.text.split_lines``, one row each, for a CTE with doc_id, path and text.
LINES = """v_lines AS (
    SELECT doc_id, path, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS line, unnest(parts) AS text FROM (
        SELECT doc_id, path, list_transform(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END, lambda x: regexp_replace(x, '\\r$', '')) AS parts
        FROM (SELECT doc_id, path, string_split(text, chr(10)) AS p FROM v_files)))"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages: host and path segments, without scheme, query and fragment."""
    url = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(url, "/+$", "").alias("path"))


TREE = """v_tree AS (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per order that has lines; it governs the files (parts) of its lines."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    governed = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("part-"), "l_partkey"))).alias("governed_files"))
    return o.join(governed, o["o_orderkey"] == governed["l_orderkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.concat(F.lit("decision-"), "o_orderkey").alias("decision"),
        "governed_files", F.col("o_orderdate").alias("last_confirmed"),
    )


DECISIONS = """v_decisions AS (
    SELECT o.o_orderkey AS id, o.o_orderpriority AS project, 'decision-' || o.o_orderkey AS decision, g.governed_files, o.o_orderdate AS last_confirmed
    FROM orders o JOIN (SELECT l_orderkey, list_sort(list_distinct(list('part-' || l_partkey))) AS governed_files FROM lineitem GROUP BY l_orderkey) g
    ON g.l_orderkey = o.o_orderkey)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.concat(F.lit("part-"), "l_partkey").alias("file"), F.col("l_shipdate").alias("ts"))


EDITS = "v_edits AS (SELECT 'part-' || l_partkey AS file, l_shipdate AS ts FROM lineitem)"


def lock_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    file = F.concat_ws("/", "event_type", (F.col("event_id") % 50).cast("string"))
    return e.select("event_id", file.alias("file_path"), F.col("user_id").cast("string").alias("agent_id"), "ts")


LOCK_REQUESTS = """v_lock_requests AS (
    SELECT event_id, event_type || '/' || (event_id % 50) AS file_path, CAST(user_id AS VARCHAR) AS agent_id, ts FROM events)"""


def modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("project"), F.concat(F.lit("u"), "user_id").alias("file"), "ts")


MODIFIED = "v_modified AS (SELECT event_id, event_type AS project, 'u' || user_id AS file, ts FROM events)"
