"""State as folds over append-only logs: upserts, decisions, decay, leases, retention, change sets.

Nothing is updated in place. Each operator is a pure function of a log and of a stated "now"; its result is the new
snapshot. Sums and latest values are combined before the shuffle, so a frequent key stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.operators.leases import LEASE_MINUTES

RETENTION_DAYS, TTL_SECONDS = 30, 300
STEP, FLOOR = 0.1, 0.1
FILES_PER_SET, SETS, KEYS_PER_PROJECT = 50, 20, 200


def latest(log: DataFrame, keys: list[str], order: list[str], values: list[str], sums: list[str] = ()) -> DataFrame:
    """One row per key: values of its last row (by order), sums over all its rows; absent numbers add nothing."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    agg = [last.alias("__last"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]]
    return log.groupBy(*keys).agg(*agg).select(*keys, "__last.*", *sums)


def keep_newest(rows: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    """The newest row of each key; of equally new rows the one with the smallest tie."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(newest).desc(), tie))
    return rows.withColumn("__n", place).filter("__n = 1").drop("__n")


def days_before(now: Column, days: int) -> Column:
    return now - F.expr(f"interval {days} days")


def purge_ledger(memory: DataFrame, now: Column, project: str | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """memory without ledger entries (tag roi) older than days, of one project or of all."""
    old = F.coalesce(F.array_contains("tags", "roi"), F.lit(False)) & (F.col("created_at") < days_before(now, days))
    if project is not None:
        old = old & (F.col("project") == project)
    return memory.filter(~old)


def purge_old(rows: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return rows.filter(F.col("created_at") >= days_before(now, days))


def confidence(edits: Column) -> Column:
    """Of a decision after a number of edits to its files since it was made or confirmed."""
    return F.greatest(F.lit(FLOOR), F.round(1 - STEP * edits, 6))


def edited_since(decisions: DataFrame, edits: DataFrame, days: int) -> DataFrame:
    """decisions (id, governed_files, last_confirmed, ...) with edit_count and confidence.

    Counts edits (file, ts) of governed files after last_confirmed and within days of it, in whatever project. The
    time range is part of the join key, in steps of days, so a file's edits meet only decisions of their time.
    """
    step = days * 86400
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    # pre-aggregate: edits of one file at one time count together
    e = edits.groupBy("file", "ts").agg(F.count(F.lit(1)).alias("times")).withColumn("slot", F.floor(seconds("ts") / step))
    d = decisions.select("id", "last_confirmed", F.explode(F.array_distinct("governed_files")).alias("file"))
    first = F.floor(seconds("last_confirmed") / step)
    d = d.withColumn("slot", F.explode(F.array(first, first + 1)))
    inside = (F.col("ts") > F.col("last_confirmed")) & (F.col("ts") <= F.col("last_confirmed") + F.expr(f"interval {days} days"))
    counted = d.join(e, ["file", "slot"]).filter(inside).groupBy("id").agg(F.sum("times").alias("edit_count"))
    out = decisions.join(counted, "id", "left").withColumn("edit_count", F.coalesce("edit_count", F.lit(0)))
    return out.withColumn("confidence", confidence(F.col("edit_count")))


def for_files(decisions: DataFrame, files: list[str], most: int = 20) -> DataFrame:
    """Decisions that govern any of files, most confident first."""
    hit = decisions.filter(F.arrays_overlap("governed_files", F.array(*map(F.lit, files))))
    return hit.orderBy(F.col("confidence").desc(), "id").limit(most)


def governing(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """Decisions that govern any file of a table (file): a semi join on the exploded array."""
    hit = decisions.select("id", F.explode("governed_files").alias("file")).join(files.select("file").distinct(), "file", "left_semi")
    return decisions.join(hit.select("id").distinct(), "id", "left_semi")


def confirmed(decisions: DataFrame, confirms: DataFrame, now: Column) -> DataFrame:
    """decisions after confirms (id, project): confidence 1, no edits, last_confirmed now; only if the project matches."""
    c = confirms.select("id", "project").distinct().withColumn("__hit", F.lit(True))
    rows = decisions.join(c, ["id", "project"], "left")
    for name, value in (("confidence", F.lit(1.0)), ("edit_count", F.lit(0).cast("long")), ("last_confirmed", now)):
        rows = rows.withColumn(name, F.when(F.col("__hit"), value).otherwise(F.col(name)))
    return rows.drop("__hit")


def first_locks(requests: DataFrame) -> DataFrame:
    """(file_path, agent_id, locked_at): the first request of each file gets its lock."""
    return requests.groupBy("file_path").agg(F.min_by(F.struct("agent_id", F.col("ts").alias("locked_at")), F.struct("ts", "event_id")).alias("l")).select("file_path", "l.*")


def active(locks: DataFrame, now: Column, minutes: int = LEASE_MINUTES) -> DataFrame:
    """Locks that have not expired: taken at most minutes before now."""
    return locks.filter(F.col("locked_at") >= now - F.expr(f"interval {minutes} minutes"))


def sessions(rows: DataFrame, key: str, gap_seconds: int, slot_seconds: int = 86_400, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """rows with session_start: the time of the first row of its run of rows at most gap_seconds apart.

    A key's rows are cut into time slots that are searched apart; then only one row per slot is ordered by key, to
    see whether a slot continues the session before it. So a key with a third of all rows is still spread.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    rows = rows.withColumn("__us", us).withColumn("__slot", F.floor(F.col("__us") / (slot_seconds * 1_000_000)))
    inside = W.partitionBy(key, "__slot").orderBy("__us", tie)
    before = F.lag("__us").over(inside)
    start = F.when(before.isNull() | (F.col("__us") - before > gap), F.col("__us"))
    rows = rows.withColumn("__new", start)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__begin", F.last("__new", True).over(upto))
    slots = rows.groupBy(key, "__slot").agg(F.min("__us").alias("first"), F.max("__us").alias("final"), F.max("__new").alias("last_begin"))
    by_slot = W.partitionBy(key).orderBy("__slot")
    joins = F.col("first") - F.lag("final").over(by_slot) <= gap
    slots = slots.withColumn("joins", F.coalesce(joins, F.lit(False)))
    # the session that is open at a slot's end began in the last slot that began one of its own
    own = F.when(~F.col("joins") | (F.col("last_begin") > F.col("first")), F.col("last_begin"))
    slots = slots.withColumn("open", F.last(own, True).over(by_slot.rowsBetween(W.unboundedPreceding, 0)))
    slots = slots.withColumn("carried", F.when(F.col("joins"), F.lag("open").over(by_slot)))
    carried = slots.filter("joins").select(key, "__slot", F.col("first").alias("__begin"), "carried")
    out = rows.join(carried, [key, "__slot", "__begin"], "left")
    begin = F.timestamp_micros(F.coalesce("carried", "__begin")).cast("timestamp_ntz")
    return out.withColumn("session_start", begin).drop("__us", "__slot", "__new", "__begin", "carried")


def change_sets(modified: DataFrame, gap_seconds: int = 2, slot_seconds: int = 86_400) -> DataFrame:
    """(project, session_start, files, n_files): files modified together, for sessions of more than one file."""
    one = sessions(modified, "project", gap_seconds, slot_seconds).select("project", "session_start", "file").distinct()
    sets = one.groupBy("project", "session_start").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sets.withColumn("n_files", F.size("files")).filter("n_files > 1")


def bounded_sets(modified: DataFrame, most_files: int = FILES_PER_SET, most_projects: int = SETS) -> DataFrame:
    """(project, files, n_files): the first files of each project by arrival, of the first projects by arrival."""
    first = modified.groupBy("project", "file").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    in_project = F.row_number().over(W.partitionBy("project").orderBy("at"))
    kept = first.withColumn("n", in_project).filter(F.col("n") <= most_files)
    sets = kept.groupBy("project").agg(F.sort_array(F.collect_list("file")).alias("files"), F.min("at").alias("at"))
    sets = sets.orderBy("at").limit(most_projects)
    return sets.select("project", "files", F.size("files").alias("n_files"))


def collected_keys(registry: DataFrame, live: DataFrame, most: int = KEYS_PER_PROJECT) -> DataFrame:
    """registry (project, key) without keys that are not live, in projects that have more than most keys."""
    sizes = registry.groupBy("project").agg(F.count_distinct("key").alias("__n"))
    full = sizes.filter(F.col("__n") > most).select("project")
    small = registry.join(full, "project", "left_anti")
    return small.unionByName(registry.join(full, "project", "left_semi").join(live, ["project", "key"], "left_semi"))


def last_sent(reads: DataFrame, now: Column, seconds: int = TTL_SECONDS) -> DataFrame:
    """The last read (agent_id, file, ts) of each agent and file that is not older than seconds."""
    last = reads.groupBy("agent_id", "file").agg(F.max("ts").alias("ts"))
    return last.filter(F.col("ts") >= now - F.expr(f"interval {seconds} seconds"))


def until_failure(checks: DataFrame) -> DataFrame:
    """Checks (run, i, command, passed) that are run: those up to and with the first that fails."""
    before = F.sum((~F.col("passed")).cast("int")).over(W.partitionBy("run").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    return checks.withColumn("__failed", before).filter(F.coalesce("__failed", F.lit(0)) == 0).drop("__failed")


def branch_label(branch: Column, sha: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(branch), F.lit("HEAD")), F.nullif(F.trim(sha), F.lit("")), F.when(F.trim(branch) == "HEAD", "HEAD"), F.lit("unknown"))
