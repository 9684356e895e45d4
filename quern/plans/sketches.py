"""Percentiles and distinct counts of weeks from what their days have stored, and SQL that sums the same buckets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quern.operators import sketches as K
from quern.plans import views as V
from quern.sources.scratch import Scratch

SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def _week() -> F.Column:
    return F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")


def _daily(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_type", "user_id", F.to_date("ts").alias("day"), (F.col("value") - 20).alias("value"))


def weekly_percentiles(spark, sf_dir):
    days = Scratch(spark, "days").table(K.bucketed(_daily(spark, sf_dir), ["event_type", "day"], "value"))
    out = K.percentiles(K.merged(days, ["event_type", _week()]), ["event_type", "week"], SHARES)
    return out.select("event_type", "week", "n", *[F.round(p, 6).alias(p) for p in SHARES])


def weekly_users(spark, sf_dir):
    """Distinct users by week: an estimate, so without SQL; tests hold its error."""
    days = Scratch(spark, "days").table(K.distinct_sketches(_daily(spark, sf_dir), ["event_type", "day"], "user_id"))
    return K.distinct_counts(days, ["event_type", _week()])


QUERIES = {f.__name__: f for f in (weekly_percentiles, weekly_users)}

_G = (1 + K.ERROR) / (1 - K.ERROR)
_AT = ", ".join(f"round(min_by(v, u) FILTER (u > floor(CAST({q} AS DOUBLE) * (total - 1))), 6) AS {name}" for name, q in SHARES.items())
ORACLE_SQL = {
    "weekly_percentiles": f"""WITH e AS (SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, value - 20 AS x FROM events WHERE isfinite(value)),
        b AS (SELECT event_type, week, CAST(sign(x) AS INTEGER) AS s, CASE WHEN x = 0 THEN 0 ELSE CAST(ceil(ln(abs(x)) / CAST('{math.log(_G)!r}' AS DOUBLE)) AS INTEGER) END AS k, count(*) AS n FROM e GROUP BY ALL),
        r AS (SELECT *, s * CAST('{2 / (_G + 1)!r}' AS DOUBLE) * pow(CAST('{_G!r}' AS DOUBLE), k) AS v, sum(n) OVER (PARTITION BY event_type, week ORDER BY s, s * k) AS u,
              sum(n) OVER (PARTITION BY event_type, week) AS total FROM b)
        SELECT event_type, week, CAST(max(total) AS BIGINT) AS n, {_AT} FROM r GROUP BY event_type, week""",
}
