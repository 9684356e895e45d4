"""Summaries per time slot that merge: percentiles and distinct counts of any window from what its slots have stored.

Percentiles come from counts in buckets whose width grows with the value, so a percentile is off by at most a stated share
of itself; merging is a sum, and gives what one pass over all rows gives. Distinct counts come from HyperLogLog sketches.
Both are combined before the shuffle, so a slot or key with a third of all rows stays spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Largest error of a percentile, as a share of it.
ERROR = 0.01
#: Registers of a distinct count are 2 to this: its standard error is 1.04 over the root of that.
REGISTERS_LOG2 = 12


def bucketed(rows: DataFrame, keys: list[str], value: str, error: float = ERROR) -> DataFrame:
    """(keys, sign, bucket, n): how many values of each key lie in a bucket; values that are null or not finite do not count.

    A bucket b holds sizes in (g^(b-1), g^b], g = (1 + error) / (1 - error); zeros are a bucket of their own (sign 0).
    """
    v = F.col(value).cast("double")
    size = F.ceil(F.ln(F.abs(v)) / F.lit(math.log((1 + error) / (1 - error)))).cast("int")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sign = F.signum(v).cast("int")
    counted = rows.filter(finite).withColumn("__sign", sign).withColumn("__bucket", F.when(v == 0, 0).otherwise(size))
    return counted.groupBy(*keys, F.col("__sign").alias("sign"), F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(buckets: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Buckets of wider keys, say of weeks from days."""
    return buckets.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(buckets: DataFrame, keys: list[str], shares: dict[str, float], error: float = ERROR) -> DataFrame:
    """(keys, n, one column a share): the value of rank floor(share * (n - 1)), from 0, by its bucket.

    A key has no more buckets than doubles have sizes at this error (about 71,000 of each sign at 0.01).
    """
    g = (1 + error) / (1 - error)
    value = F.col("sign") * F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bucket").cast("double"))
    by_key = W.partitionBy(*keys)
    upto = F.sum("n").over(by_key.orderBy(F.col("sign"), F.col("sign") * F.col("bucket")))
    ranked = buckets.withColumn("__upto", upto).withColumn("__all", F.sum("n").over(by_key)).withColumn("__value", value)
    at = lambda q: F.min_by("__value", F.when(F.col("__upto") > F.floor(F.lit(q) * (F.col("__all") - 1)), F.col("__upto")))
    return ranked.groupBy(*keys).agg(F.max("__all").alias("n"), *[at(q).alias(name) for name, q in shares.items()])


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, log2: int = REGISTERS_LOG2) -> DataFrame:
    """(keys, sketch): of the values of each key; nulls do not count."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, log2).alias("sketch"))


def distinct_counts(sketches: DataFrame, keys: list[str | Column]) -> DataFrame:
    """(keys, n_distinct): estimates for wider keys, from their slots' sketches."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
