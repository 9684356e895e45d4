"""Queries over decisions, locks, change sets and retention, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import leases
from quern.operators import state as S
from quern.plans import views as V

FILES = ["part-1", "part-5", "part-77"]
DAYS = 30
#: Minutes: events of one file are hours apart.
LEASE = 12 * 60


def _ts(text):
    return F.expr(f"timestamp_ntz'{text}'")


def _store_log(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("project"), F.concat(F.lit("k"), "user_id").alias("key"), F.col("props").alias("content"), F.col("ts").alias("created_at"),
                    F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("agent-"), F.col("user_id") % 5)).alias("agent_id"),
                    F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("long")).alias("token_saved"), F.get_json_object("props", "$.k").cast("long").alias("token_usage"),
                    F.when(F.col("event_id") % 2 == 0, F.array(F.lit("roi"), "event_type")).otherwise(F.array("event_type")).alias("tags"),
                    F.when(F.col("event_id") % 4 != 0, F.array("value")).alias("embedding"))


def _day(df, *names):
    for n in names:
        df = df.withColumn(n, F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return df


def memory_upsert(spark, sf_dir):
    out = S.latest(_store_log(spark, sf_dir), ["project", "key"], ["created_at", "event_id"], ["content", "tags", "embedding", "created_at", "agent_id"], ["token_saved", "token_usage"])
    return _day(out.withColumn("tags", F.array_join("tags", ",")).withColumn("embedding", F.col("embedding")[0]), "created_at")


def dedup_latest(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    newest = S.keep_newest(o, ["o_orderpriority", "o_custkey"], "o_orderdate", "o_orderkey")
    return newest.select("o_orderpriority", "o_custkey", "o_orderkey")


def _decayed(spark, sf_dir):
    return S.edited_since(V.decisions(spark, sf_dir), V.edits(spark, sf_dir), DAYS)


def confidence_decay(spark, sf_dir):
    return _decayed(spark, sf_dir).select("id", "project", "edit_count", "confidence")


def decisions_for_files(spark, sf_dir):
    out = S.for_files(_decayed(spark, sf_dir), FILES)
    return out.select("id", "project", F.array_join("governed_files", ",").alias("governed_files"), "confidence")


def decisions_semi_join(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").filter("p_size = 7").select(F.concat(F.lit("part-"), "p_partkey").alias("file"))
    return S.governing(V.decisions(spark, sf_dir), p).select("id", "project")


def confirm_decision(spark, sf_dir):
    c = V.table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"), F.lit("1-URGENT").alias("project"))
    out = S.confirmed(_decayed(spark, sf_dir), c, _ts("2024-01-31 00:00:00"))
    return _day(out.select("id", "project", "edit_count", "confidence", "last_confirmed"), "last_confirmed")


def decision_upsert(spark, sf_dir):
    """Orders record decisions again and again: the last gives context and time, returned lines are edits since the first."""
    o, l = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    log = o.select(F.col("o_orderpriority").alias("project"), F.col("o_custkey").alias("decision"), F.col("o_orderstatus").alias("context"), F.col("o_orderdate").alias("last_confirmed"), "o_orderkey")
    now = S.latest(log, ["project", "decision"], ["last_confirmed", "o_orderkey"], ["context", "last_confirmed"])
    made = log.groupBy("project", "decision").agg(F.min("last_confirmed").alias("created_at"))
    edits = l.filter("l_returnflag = 'R'").join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_orderpriority").alias("project"), F.col("o_custkey").alias("decision"), "l_shipdate")
    counted = edits.join(made, ["project", "decision"]).filter("l_shipdate > created_at").groupBy("project", "decision").agg(F.count(F.lit(1)).alias("edit_count"))
    out = now.join(made, ["project", "decision"]).join(counted, ["project", "decision"], "left").withColumn("edit_count", F.coalesce("edit_count", F.lit(0)))
    return _day(out.withColumn("confidence", S.confidence(F.col("edit_count"))), "last_confirmed", "created_at")


def lock_first_wins(spark, sf_dir):
    return _day(S.first_locks(V.lock_requests(spark, sf_dir)), "locked_at")


def active_locks(spark, sf_dir):
    r = V.lock_requests(spark, sf_dir)
    last = r.groupBy("file_path").agg(F.max_by(F.struct("agent_id", F.col("ts").alias("locked_at")), F.struct("ts", "event_id")).alias("l")).select("file_path", "l.*")
    now = r.agg(F.max("ts").alias("now"))
    return _day(S.active(last.crossJoin(F.broadcast(now)), F.col("now"), 24 * 60).drop("now"), "locked_at")


def lock_decision(spark, sf_dir):
    return leases.lock_answers(V.lock_requests(spark, sf_dir), LEASE).select("event_id", "file_path", "agent_id", "holder", "answer")


def lock_replay(spark, sf_dir):
    r = V.lock_requests(spark, sf_dir).withColumn("action", F.when(F.col("event_id") % 4 == 0, "unlock").otherwise("lock"))
    return leases.replay_locks(r, LEASE).select("event_id", "file_path", "agent_id", "action", "granted")


def co_change_sets(spark, sf_dir):
    out = S.change_sets(V.modified(spark, sf_dir), 600)
    return _day(out.withColumn("files", F.array_join("files", ",")).withColumn("n_files", F.col("n_files").cast("long")), "session_start")


def recent_co_changes(spark, sf_dir):
    out = S.purge_old(S.change_sets(V.modified(spark, sf_dir), 600).withColumnRenamed("session_start", "created_at"), _ts(V.NOW), 14)
    out = out.orderBy(F.col("created_at").desc(), "project").limit(50)
    return _day(out.withColumn("files", F.array_join("files", ",")).withColumn("n_files", F.col("n_files").cast("long")), "created_at")


def modified_sets(spark, sf_dir):
    out = S.bounded_sets(V.modified(spark, sf_dir))
    return out.select("project", F.array_join("files", ",").alias("files"), F.col("n_files").cast("long").alias("n_files"))


def registry_gc(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    registry = e.select(F.col("event_type").alias("project"), F.col("user_id").alias("key")).distinct()
    live = e.filter(F.col("ts") >= _ts("2024-01-29 00:00:00")).select(F.col("event_type").alias("project"), F.col("user_id").alias("key")).distinct()
    return S.collected_keys(registry, live, 100)


def last_sent_live(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    reads = e.select(F.col("user_id").cast("string").alias("agent_id"), F.col("event_type").alias("file"), "ts")
    return _day(S.last_sent(reads, _ts("2024-01-30 12:00:00"), 86_400), "ts")


def purge_roi_project(spark, sf_dir):
    m = V.memory(spark, sf_dir)
    return S.purge_ledger(m, _ts("2024-01-31 06:00:00"), "en").select("key", "project")


def purge_stale(spark, sf_dir):
    return S.purge_ledger(V.memory(spark, sf_dir), _ts("2024-01-31 06:00:00")).select("key", "project")


def checks_until_failure(spark, sf_dir):
    """Lines of an order as its checks in order; lines that were returned fail."""
    l = V.table(spark, sf_dir, "lineitem")
    checks = l.select(F.col("l_orderkey").alias("run"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("i"), F.col("l_partkey").alias("command"), (F.col("l_returnflag") != "R").alias("passed"))
    ran = S.until_failure(checks)
    return ran.groupBy("run").agg(F.count(F.lit(1)).alias("n_run"), F.bool_and("passed").alias("passed"))


def branch_label(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer")
    branch = F.when(F.col("c_custkey") % 3 == 0, "HEAD").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    sha = F.when(F.col("c_custkey") % 2 == 0, F.substring(F.md5(F.col("c_name").cast("binary")), 1, 7))
    return c.select("c_custkey", S.branch_label(branch, sha).alias("label"))


def format_ts(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm 'UTC'").alias("shown"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("rfc3339"))


def parse_requests(spark, sf_dir):
    """Arguments from JSON: what is malformed or missing becomes a default, and is marked."""
    e = V.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 5 == 1, F.lit("{}")).otherwise(F.col("props"))
    got = F.from_json(raw, "k bigint, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = e.select("event_id", got.alias("g"))
    return rows.select("event_id", F.coalesce("g.k", F.lit(5)).alias("k"), F.col("g._corrupt_record").isNotNull().alias("malformed"))


QUERIES = {f.__name__: f for f in (memory_upsert, dedup_latest, confidence_decay, decisions_for_files, decisions_semi_join, confirm_decision, decision_upsert, lock_first_wins, active_locks, lock_decision, lock_replay, co_change_sets, recent_co_changes, modified_sets, registry_gc, last_sent_live, purge_roi_project, purge_stale, checks_until_failure, branch_label, format_ts, parse_requests)}

_US = "'%Y-%m-%d %H:%M:%S.%f'"
_DECAYED = f"""{V.DECISIONS}, {V.EDITS},
g AS (SELECT id, last_confirmed, unnest(governed_files) AS file FROM v_decisions),
n AS (SELECT id, count(*) AS edit_count FROM g JOIN v_edits e ON e.file = g.file AND e.ts > g.last_confirmed AND e.ts <= g.last_confirmed + INTERVAL {DAYS} DAY GROUP BY id),
v_decayed AS (SELECT d.*, coalesce(edit_count, 0) AS edit_count, greatest(0.1::DOUBLE, round(1 - 0.1::DOUBLE * coalesce(edit_count, 0), 6)) AS confidence
              FROM v_decisions d LEFT JOIN n USING (id))"""
_STORE = """s AS (SELECT event_id, event_type AS project, 'k' || user_id AS key, props AS content, ts AS created_at,
    CASE WHEN event_id % 7 <> 0 THEN 'agent-' || (user_id % 5) END AS agent_id,
    CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value) AS BIGINT) END AS token_saved, CAST(json_extract_string(props, '$.k') AS BIGINT) AS token_usage,
    CASE WHEN event_id % 2 = 0 THEN 'roi,' || event_type ELSE event_type END AS tags, CASE WHEN event_id % 4 <> 0 THEN value END AS embedding FROM events)"""
_SESSIONS = f"""{V.MODIFIED}, b AS (SELECT *, lag(ts) OVER (PARTITION BY project ORDER BY ts, event_id) AS before FROM v_modified),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts, event_id) AS island FROM b),
c AS (SELECT project, min(ts) AS session_start, array_to_string(list_sort(list(DISTINCT file)), ',') AS files, count(DISTINCT file) AS n_files
      FROM i GROUP BY project, island HAVING count(DISTINCT file) > 1)"""

ORACLE_SQL = {
    "memory_upsert": f"""WITH {_STORE}, r AS (SELECT *, row_number() OVER (PARTITION BY project, key ORDER BY created_at DESC, event_id DESC) AS n,
        CAST(coalesce(sum(token_saved) OVER (PARTITION BY project, key), 0) AS BIGINT) AS saved, CAST(coalesce(sum(token_usage) OVER (PARTITION BY project, key), 0) AS BIGINT) AS used FROM s)
        SELECT project, key, content, tags, embedding, strftime(created_at, {_US}) AS created_at, agent_id, saved AS token_saved, used AS token_usage FROM r WHERE n = 1""",
    "dedup_latest": """SELECT o_orderpriority, o_custkey, o_orderkey FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
    "confidence_decay": f"WITH {_DECAYED} SELECT id, project, edit_count, confidence FROM v_decayed",
    "decisions_for_files": f"""WITH {_DECAYED} SELECT id, project, array_to_string(governed_files, ',') AS governed_files, confidence FROM v_decayed
        WHERE list_has_any(governed_files, {FILES}) ORDER BY confidence DESC, id LIMIT 20""",
    "decisions_semi_join": f"""WITH {V.DECISIONS} SELECT id, project FROM v_decisions WHERE EXISTS (
        SELECT 1 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size = 7 AND l.l_orderkey = id)""",
    "confirm_decision": f"""WITH {_DECAYED}, h AS (SELECT *, id % 10 = 0 AND project = '1-URGENT' AS hit FROM v_decayed)
        SELECT id, project, CASE WHEN hit THEN 0 ELSE edit_count END AS edit_count, CASE WHEN hit THEN 1.0 ELSE confidence END AS confidence,
               strftime(CASE WHEN hit THEN TIMESTAMP '2024-01-31' ELSE last_confirmed END, {_US}) AS last_confirmed FROM h""",
    "decision_upsert": f"""WITH w AS (SELECT *, min(o_orderdate) OVER (PARTITION BY o_orderpriority, o_custkey) AS created,
            row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
        e AS (SELECT w.o_orderpriority, w.o_custkey, count(*) AS edits FROM lineitem JOIN w ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_shipdate > created GROUP BY ALL)
        SELECT w.o_orderpriority AS project, w.o_custkey AS decision, o_orderstatus AS context, strftime(o_orderdate, {_US}) AS last_confirmed, strftime(created, {_US}) AS created_at,
               coalesce(edits, 0) AS edit_count, greatest(0.1::DOUBLE, round(1 - 0.1::DOUBLE * coalesce(edits, 0), 6)) AS confidence
        FROM w LEFT JOIN e ON e.o_orderpriority = w.o_orderpriority AND e.o_custkey = w.o_custkey WHERE n = 1""",
    "lock_first_wins": f"""WITH {V.LOCK_REQUESTS} SELECT file_path, agent_id, strftime(ts, {_US}) AS locked_at FROM v_lock_requests
        QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY ts, event_id) = 1""",
    "active_locks": f"""WITH {V.LOCK_REQUESTS}, l AS (SELECT * FROM v_lock_requests QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, event_id DESC) = 1)
        SELECT file_path, agent_id, strftime(ts, {_US}) AS locked_at FROM l WHERE ts >= (SELECT max(ts) FROM v_lock_requests) - INTERVAL 1 DAY""",
    "lock_decision": f"""WITH RECURSIVE {V.LOCK_REQUESTS},
        taken AS (SELECT * FROM v_lock_requests QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY ts, event_id) = 1
                  UNION ALL SELECT r.* FROM taken t JOIN v_lock_requests r ON r.file_path = t.file_path AND r.ts > t.ts + INTERVAL {LEASE} MINUTE
                  QUALIFY row_number() OVER (PARTITION BY r.file_path ORDER BY r.ts, r.event_id) = 1),
        w AS (SELECT r.*, t.agent_id AS holder, t.event_id AS lease FROM v_lock_requests r JOIN taken t ON t.file_path = r.file_path AND (t.ts, t.event_id) <= (r.ts, r.event_id)
              QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY t.ts DESC, t.event_id DESC) = 1)
        SELECT event_id, file_path, agent_id, holder, CASE WHEN event_id = lease THEN 'acquired' WHEN agent_id = holder THEN 'already_held' ELSE 'locked' END AS answer FROM w""",
    "lock_replay": f"""WITH RECURSIVE {V.LOCK_REQUESTS},
        r AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'unlock' ELSE 'lock' END AS action, row_number() OVER (PARTITION BY file_path ORDER BY ts, event_id) AS n FROM v_lock_requests),
        s AS (SELECT event_id, file_path, agent_id, action, n, action = 'lock' AS granted, CASE WHEN action = 'lock' THEN agent_id END AS holder, ts AS since FROM r WHERE n = 1
              UNION ALL
              SELECT event_id, file_path, agent_id, action, n, CASE WHEN action = 'lock' THEN h IS NULL OR h = agent_id ELSE coalesce(h = agent_id, false) END AS granted,
                     CASE WHEN action = 'lock' THEN coalesce(h, agent_id) WHEN h = agent_id THEN NULL ELSE h END AS holder, CASE WHEN h IS NULL THEN ts ELSE since END AS since
              FROM (SELECT r.*, s.since, CASE WHEN r.ts - s.since <= INTERVAL {LEASE} MINUTE THEN s.holder END AS h FROM s JOIN r ON r.file_path = s.file_path AND r.n = s.n + 1))
        SELECT event_id, file_path, agent_id, action, granted FROM s""",
    "co_change_sets": f"WITH {_SESSIONS} SELECT project, strftime(session_start, {_US}) AS session_start, files, n_files FROM c",
    "recent_co_changes": f"""WITH {_SESSIONS} SELECT project, strftime(session_start, {_US}) AS created_at, files, n_files FROM c
        WHERE session_start >= TIMESTAMP '{V.NOW}' - INTERVAL 14 DAY ORDER BY session_start DESC, project LIMIT 50""",
    "modified_sets": f"""WITH {V.MODIFIED}, f AS (SELECT project, file, ts, event_id FROM v_modified QUALIFY row_number() OVER (PARTITION BY project, file ORDER BY ts, event_id) = 1),
        k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts, event_id) <= 50)
        SELECT project, array_to_string(list_sort(list(file)), ',') AS files, count(*) AS n_files FROM k GROUP BY project ORDER BY min(ts) LIMIT 20""",
    "registry_gc": """WITH r AS (SELECT DISTINCT event_type AS project, user_id AS key FROM events), l AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29'),
        f AS (SELECT project FROM r GROUP BY project HAVING count(*) > 100)
        SELECT project, key FROM r WHERE project NOT IN (SELECT project FROM f) OR EXISTS (SELECT 1 FROM l WHERE l.event_type = r.project AND l.user_id = r.key)""",
    "last_sent_live": f"""SELECT CAST(user_id AS VARCHAR) AS agent_id, event_type AS file, strftime(max(ts), {_US}) AS ts FROM events
        GROUP BY ALL HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY""".replace("GROUP BY ALL", "GROUP BY user_id, event_type"),
    "purge_roi_project": f"""WITH {V.MEMORY} SELECT key, project FROM v_memory
        WHERE NOT (list_contains(tags, 'roi') AND created_at < TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 30 DAY AND project = 'en')""",
    "purge_stale": f"""WITH {V.MEMORY} SELECT key, project FROM v_memory
        WHERE NOT (list_contains(tags, 'roi') AND created_at < TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 30 DAY)""",
    "checks_until_failure": """WITH f AS (SELECT *, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM lineitem)
        SELECT l_orderkey AS run, count(*) AS n_run, bool_and(l_returnflag <> 'R') AS passed FROM f WHERE failed = 0 GROUP BY l_orderkey""",
    "branch_label": """SELECT c_custkey, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN 'HEAD' WHEN 1 THEN c_mktsegment END, 'HEAD'),
        CASE WHEN c_custkey % 2 = 0 THEN substr(md5(c_name), 1, 7) END, CASE WHEN c_custkey % 3 = 0 THEN 'HEAD' END, 'unknown') AS label FROM customer""",
    "format_ts": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC') AS shown, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS rfc3339 FROM events",
    "parse_requests": """SELECT event_id, coalesce(CASE WHEN event_id % 5 > 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END, 5) AS k,
        event_id % 5 = 0 AS malformed FROM events""",
}
