"""Grouped sums of a usage ledger, with windows, totals and percentages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that a report's name stands for.
WINDOWS = {"day": 1, "week": 7, "month": 28}
NO_PROJECT = "internal"


def narrowed(rows: DataFrame, now: str, window: str | None = None, project: str | None = None) -> DataFrame:
    """rows since the window's start and of the project, where given; an unknown window selects no rows."""
    if window is not None and window not in WINDOWS:
        return rows.filter(F.lit(False))
    if window is not None:
        rows = rows.filter(F.col("created_at") >= F.expr(f"timestamp_ntz'{now}' - interval {WINDOWS[window]} days"))
    if project is not None:
        rows = rows.filter(F.col("project") == project)
    return rows


def _sums() -> list:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{n}") for c, n in (("token_saved", "saved"), ("token_usage", "usage"))]


def stats(rows: DataFrame) -> DataFrame:
    """(agent_id, project, total_saved, total_usage); rows without an agent are a group; sums of nothing are 0."""
    return rows.groupBy("agent_id", "project").agg(*_sums())


def with_percent(sums: DataFrame) -> DataFrame:
    """pct: saved of used in percent, 0 where nothing was used."""
    pct = F.when(F.col("total_usage") > 0, F.round(F.col("total_saved") / F.col("total_usage") * 100, 4)).otherwise(F.lit(0.0))
    return sums.withColumn("pct", pct)


def with_grand_total(rows: DataFrame) -> DataFrame:
    """The groups of ``stats`` and one row of all (level 'total'), in one aggregation by grouping sets."""
    sets = rows.groupingSets([["agent_id", "project"], []], "agent_id", "project")
    out = sets.agg(*_sums(), F.grouping_id("agent_id", "project").alias("__g"))
    return out.select(F.when(F.col("__g") == 3, "total").otherwise("group").alias("level"), "agent_id", "project", "total_saved", "total_usage")


def dump(memory: DataFrame, project: str | None = None, most: int = 100) -> DataFrame:
    """The first most records by key, with ``more``: whether there are others (one more row is read to know)."""
    from pyspark.sql import Window as W

    rows = memory if project is None else memory.filter(F.col("project") == project)
    probe = rows.orderBy("key").limit(most + 1)
    numbered = probe.withColumn("__n", F.row_number().over(W.orderBy("key"))).withColumn("more", F.count(F.lit(1)).over(W.partitionBy()) > most)
    return numbered.filter(F.col("__n") <= most).drop("__n")


def from_reads(reads: DataFrame) -> DataFrame:
    """Ledger rows of reads (agent_id, project, path, raw, sent, ts) that saved something; a token is four bytes. Reads
    outside any project go to a project of their own."""
    saved = F.greatest(F.lit(0), F.col("raw") - F.col("sent"))
    rows = reads.withColumn("__saved", saved).filter("__saved > 0")
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    return rows.select(
        F.concat_ws("_", F.lit("token_savings"), "agent_id", "path", nanos).alias("key"), F.array(F.lit("roi"), F.lit("token_savings")).alias("tags"), "agent_id",
        F.coalesce("project", F.lit(NO_PROJECT)).alias("project"), F.concat(F.lit("Saved "), F.floor(F.col("__saved") / 4).cast("long"), F.lit(" tokens by pruning "), "path").alias("content"),
        F.floor(F.col("__saved") / 4).cast("long").alias("token_saved"), F.floor(F.col("raw") / 4).cast("long").alias("token_usage"), F.col("ts").alias("created_at"),
    )


def report(sums: DataFrame, width: int = 24) -> DataFrame:
    """(line, text): groups of ``stats`` as lines of fixed width, by agent and project, longer names cut; then the sum."""
    from pyspark.sql import Window as W

    name = lambda c, none: F.rpad(F.coalesce(c, F.lit(none)), width, " ")
    number = lambda c: F.lpad(F.col(c).cast("string"), 12, " ")
    pct = F.lpad(F.concat(F.format_string("%.1f", F.round("pct", 1)), F.lit("%")), 9, " ")
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_saved", "total_usage")])
    rows = sums.select("agent_id", "project", "total_saved", "total_usage", F.lit(0).alias("last"))
    every = rows.unionByName(total.select(F.lit("TOTAL").alias("agent_id"), F.lit("").alias("project"), "total_saved", "total_usage", F.lit(1).alias("last")))
    text = F.concat(name(F.col("agent_id"), "unknown"), F.lit(" "), name(F.col("project"), ""), number("total_saved"), number("total_usage"), pct)
    order = W.orderBy("last", F.col("agent_id").asc_nulls_first(), F.col("project").asc_nulls_first())  # a row for each agent and project
    return with_percent(every).select(F.row_number().over(order).alias("line"), text.alias("text"))
