"""Streaming queries, run over all events that there are, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans import state
from quern.plans import views as V
from quern.sources.scratch import Scratch
from quern.streaming import streams as S


def _events(spark, sf_dir):
    return S.file_stream(spark, sf_dir, "events.parquet", S.EVENTS)


def stream_ingest(spark, sf_dir):
    return S.drained(_events(spark, sf_dir).filter("event_type <> 'error'").select("event_id", "user_id", "event_type"))


def co_change_stream(spark, sf_dir):
    """Without the sessions that end within the lateness of the last event: those are still open."""
    modified = _events(spark, sf_dir).select(F.col("event_type").alias("project"), F.concat(F.lit("u"), "user_id").alias("file"), "ts")
    bounds, slots = (S.drained(f(modified, "10 minutes", "1 hour")) for f in (S.session_bounds, S.slot_files))
    out = S.change_sets(bounds, slots, "10 minutes")
    return out.select("project", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), F.array_join("files", ",").alias("files"))


def g_stream_windows(spark, sf_dir):
    out = S.drained(S.window_counts(_events(spark, sf_dir), "6 hours"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def modified_sets_stream(spark, sf_dir):
    """The sets of modified_sets, from events that come in batches of two files and in no order."""
    files = Scratch(spark, "batches").table(V.table(spark, sf_dir, "events").repartition(8, "event_id"))
    events = S.file_stream(spark, files._quern_path, "*.parquet", S.EVENTS, 2)
    modified = events.select("event_id", F.col("event_type").alias("project"), F.concat(F.lit("u"), "user_id").alias("file"), "ts")
    out = S.newest_sets(S.drained(S.bounded_sets(modified), closing=False, rocksdb=True))
    return out.select("project", F.array_join("files", ",").alias("files"), F.col("n_files").cast("long").alias("n_files"))


QUERIES = {f.__name__: f for f in (stream_ingest, co_change_stream, g_stream_windows, modified_sets_stream)}

ORACLE_SQL = {
    "modified_sets_stream": state.ORACLE_SQL["modified_sets"],
    "stream_ingest": "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'",
    "g_stream_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "co_change_stream": """WITH b AS (SELECT event_type AS project, 'u' || user_id AS file, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before, event_id FROM events),
        i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts, event_id) AS island FROM b)
        SELECT project, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM i
        GROUP BY project, island HAVING count(DISTINCT file) > 1 AND max(ts) + INTERVAL 600 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
}
