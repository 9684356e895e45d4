"""Relational operators beyond the inventory that callers of a query engine expect, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.plans.views import table


def g_joins(spark, sf_dir):
    """Inner, left, semi and anti joins of customers and orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    left = c.join(per, c["c_custkey"] == per["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "total")
    idle = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey").withColumn("idle", F.lit(True))
    return left.join(idle, "c_custkey", "left").withColumn("idle", F.coalesce("idle", F.lit(False)))


def g_full_join(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    per = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    return n.join(per, n["n_nationkey"] == per["s_nationkey"], "full_outer").select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def g_asof_join(spark, sf_dir):
    """For each purchase the user's last view before it: one pass over both, ordered by user and time."""
    e = table(spark, sf_dir, "events").filter("event_type in ('view', 'purchase')")
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True)
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("view_id", seen.over(w)).filter("event_type = 'purchase'").select("event_id", "view_id")


def g_range_join(spark, sf_dir):
    """Orders placed in each month, by an equality on the month and a range within it."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    months = o.select("month").distinct().withColumn("mid", F.col("month") + F.expr("interval 14 days"))
    half = o.join(months, "month").filter(F.col("o_orderdate") < F.col("mid"))
    return half.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def g_cube(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def g_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


def g_window_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey", F.col("r").cast("long").alias("r"))


def g_window_frame(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    moving = F.avg("value").over(w.rowsBetween(-4, 0))
    return e.select("event_id", F.round(moving, 6).alias("moving"), F.lead("event_type").over(w).alias("next"))


def g_set_ops(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    part = lambda df, name: df.withColumn("op", F.lit(name))
    return part(c.intersect(s), "intersect").unionByName(part(c.subtract(s), "except")).unionByName(part(c.union(s).distinct(), "union"))


def g_time_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = e.groupBy(F.window(F.col("ts"), "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def g_pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'2000-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (g_joins, g_full_join, g_asof_join, g_range_join, g_cube, g_rollup, g_window_rank, g_window_frame, g_set_ops, g_time_windows, g_pricing_summary)}

ORACLE_SQL = {
    "g_joins": """SELECT c_custkey, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total, count(o_orderkey) = 0 AS idle
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "g_full_join": "SELECT n_name, count(s_suppkey) AS suppliers FROM nation FULL JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    "g_asof_join": """SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "g_range_join": """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders
        WHERE o_orderdate < date_trunc('month', o_orderdate) + INTERVAL 14 DAY GROUP BY 1""",
    "g_cube": """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "g_rollup": "SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "g_window_rank": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 3",
    "g_window_frame": """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving,
        lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events""",
    "g_set_ops": """SELECT k, 'intersect' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT k, 'except' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT k, 'union' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""",
    "g_time_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "g_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""",
}
