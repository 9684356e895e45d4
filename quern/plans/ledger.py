"""Ledger queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import safe_truncate
from quern.operators import ledger as L
from quern.plans import views as V


def stats_by_agent_project(spark, sf_dir):
    return L.stats(V.ledger(spark, sf_dir))


def _window(window):
    return lambda spark, sf_dir: L.stats(L.narrowed(V.ledger(spark, sf_dir), V.NOW, window))


def stats_project(spark, sf_dir):
    return L.stats(L.narrowed(V.ledger(spark, sf_dir), V.NOW, project="purchase"))


def stats_timeframe(spark, sf_dir):
    return L.stats(L.narrowed(V.ledger(spark, sf_dir), V.NOW, "week", "purchase"))


def stats_grand_total(spark, sf_dir):
    return L.with_grand_total(V.ledger(spark, sf_dir))


def stats_pct(spark, sf_dir):
    return L.with_percent(L.with_grand_total(V.ledger(spark, sf_dir)))


def dump_capped(spark, sf_dir):
    out = L.dump(V.memory(spark, sf_dir))
    return out.select("key", "project", F.array_join("tags", ",").alias("tags"), "agent_id", "token_saved", "token_usage", "more")


def ledger_from_reads(spark, sf_dir):
    """Reads of documents that send 4096 bytes at most."""
    d = V.table(spark, sf_dir, "documents")
    raw = F.octet_length("text").cast("long")
    reads = d.select(F.concat(F.lit("agent-"), F.col("doc_id") % 7).alias("agent_id"), F.col("lang").alias("project"), F.concat_ws("/", "source", "doc_id").alias("path"), raw.alias("raw"),
                     F.octet_length(safe_truncate(F.col("text"), 4096)).cast("long").alias("sent"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"))
    rows = L.from_reads(reads)
    return rows.select("key", F.array_join("tags", ",").alias("tags"), "agent_id", "project", "content", "token_saved", "token_usage")


def stats_report(spark, sf_dir):
    return L.report(L.stats(L.narrowed(V.ledger(spark, sf_dir), V.NOW, "week")))


QUERIES = {f.__name__: f for f in (stats_by_agent_project, stats_project, stats_timeframe, stats_grand_total, stats_pct, dump_capped, ledger_from_reads, stats_report)}
QUERIES |= {f"stats_{w}": _window(w) for w in L.WINDOWS}

_SUMS = "CAST(coalesce(sum(token_saved), 0) AS BIGINT) AS total_saved, CAST(coalesce(sum(token_usage), 0) AS BIGINT) AS total_usage"
_BY = f"SELECT agent_id, project, {_SUMS} FROM v_ledger"
_TOTAL = f"""SELECT 'group' AS level, agent_id, project, {_SUMS} FROM v_ledger GROUP BY agent_id, project
    UNION ALL SELECT 'total', NULL, NULL, {_SUMS} FROM v_ledger"""

ORACLE_SQL = {
    "stats_report": f"""WITH {V.LEDGER}, g AS ({_BY} WHERE created_at >= TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY GROUP BY agent_id, project),
        e AS (SELECT *, 0 AS last FROM g UNION ALL SELECT 'TOTAL', '', CAST(coalesce(sum(total_saved), 0) AS BIGINT), CAST(coalesce(sum(total_usage), 0) AS BIGINT), 1 FROM g)
        SELECT CAST(row_number() OVER (ORDER BY last, agent_id NULLS FIRST, project NULLS FIRST) AS INTEGER) AS line,
               rpad(coalesce(agent_id, 'unknown'), 24, ' ') || ' ' || rpad(coalesce(project, ''), 24, ' ') || lpad(CAST(total_saved AS VARCHAR), 12, ' ') || lpad(CAST(total_usage AS VARCHAR), 12, ' ')
               || lpad(printf('%.1f', round(CASE WHEN total_usage > 0 THEN round(total_saved / total_usage * 100, 4) ELSE 0.0 END, 1)) || '%', 9, ' ') AS text FROM e""",
    "stats_by_agent_project": f"WITH {V.LEDGER} {_BY} GROUP BY agent_id, project",
    "stats_project": f"WITH {V.LEDGER} {_BY} WHERE project = 'purchase' GROUP BY agent_id, project",
    "stats_timeframe": f"WITH {V.LEDGER} {_BY} WHERE project = 'purchase' AND created_at >= TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY GROUP BY agent_id, project",
    "stats_grand_total": f"WITH {V.LEDGER} {_TOTAL}",
    "stats_pct": f"WITH {V.LEDGER} SELECT *, CASE WHEN total_usage > 0 THEN round(total_saved / total_usage * 100, 4) ELSE 0.0 END AS pct FROM ({_TOTAL})",
    "dump_capped": f"""WITH {V.MEMORY} SELECT key, project, array_to_string(tags, ',') AS tags, agent_id, token_saved, token_usage,
        (SELECT count(*) FROM v_memory) > 100 AS more FROM v_memory ORDER BY key LIMIT 100""",
    "ledger_from_reads": """SELECT 'token_savings_agent-' || (doc_id % 7) || '_' || source || '/' || doc_id || '_1704067200000000000' AS key, 'roi,token_savings' AS tags,
        'agent-' || (doc_id % 7) AS agent_id, coalesce(lang, 'internal') AS project,
        'Saved ' || (saved // 4) || ' tokens by pruning ' || source || '/' || doc_id AS content, saved // 4 AS token_saved, raw // 4 AS token_usage
        FROM (SELECT *, raw - strlen(CASE WHEN raw <= 4096 THEN text ELSE left(text, list_max(list_filter(range(1024, 4097), lambda n: strlen(left(text, n)) <= 4096)))
                        || chr(10) || '... [output truncated]' END) AS saved
              FROM (SELECT *, strlen(text) AS raw FROM documents)) WHERE saved > 0""",
}
for _name, _days in L.WINDOWS.items():
    ORACLE_SQL[f"stats_{_name}"] = f"WITH {V.LEDGER} {_BY} WHERE created_at >= TIMESTAMP '{V.NOW}' - INTERVAL {_days} DAY GROUP BY agent_id, project"
