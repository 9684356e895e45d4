"""Connected components by alternating star contraction; no task ever holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch


def _stars(edges: DataFrame, by: str, other: str) -> DataFrame:
    """Every row joined with the smallest ``other`` of its ``by``. Minima are combined before the shuffle."""
    least = edges.groupBy(by).agg(F.min(other).alias("least"))
    return edges.join(least, by)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of an edge list of longs; root is the component's smallest node.

    Each round links a node's larger neighbours to its smallest one (large star) and then a node's smaller
    neighbours to the smallest of them (small star). Edges never multiply, and rounds grow with the logarithm
    of the longest chain. Loops, repeated and reversed edges do no harm; edges with a null end are ignored;
    no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    now = scratch.table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        # a node without smaller neighbours is its star's centre already
        large = scratch.table(large.filter("a <> b").distinct())
        small = _stars(large, "a", "b").selectExpr("a", "b", "least")
        moved = small.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        after = scratch.table(small.select("a", F.col("least").alias("b")).unionByName(moved).distinct())
        scratch.drop(now)
        scratch.drop(large)
        now = after
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == seen or check[0] == 0:
            break
        seen = check
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
