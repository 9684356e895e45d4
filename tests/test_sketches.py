import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quern.operators import sketches as K
from quern.plans import sketches as plan
from tests.conftest import DATA

SHARES = {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}


def test_percentiles_are_within_their_error_and_merge(spark):
    r = random.Random(1)
    draw = [lambda: r.lognormvariate(0, 5), lambda: -r.expovariate(0.001), lambda: 0.0, lambda: r.uniform(-1, 1), lambda: float(r.randrange(5))]
    rows = [(key, slot, r.choice(draw)()) for key in "ab" for slot in range(6) for _ in range(300)]
    odd = [("a", 0, None), ("a", 1, math.nan), ("b", 2, math.inf), ("b", 2, -math.inf), ("c", 1, None), ("d", 1, 5e-324), ("d", 2, 1.7e308)]
    df = spark.createDataFrame(rows + odd, "key string, slot int, value double")
    slots = K.bucketed(df, ["key", "slot"], "value")
    got = {x["key"]: x for x in K.percentiles(K.merged(slots, ["key"]), ["key"], SHARES).collect()}
    assert got.keys() == {"a", "b", "d"}  # a key without a value has no row
    values = defaultdict(list)
    for key, _, v in rows + odd:
        if v is not None and math.isfinite(v):
            values[key].append(v)
    for key in "ab":
        own = sorted(values[key])
        assert got[key]["n"] == len(own)
        for name, q in SHARES.items():
            exact = own[math.floor(q * (len(own) - 1))]
            assert abs(got[key][name] - exact) <= K.ERROR * abs(exact) * (1 + 1e-9)
    whole = K.percentiles(K.bucketed(df, ["key"], "value"), ["key"], SHARES)
    assert sorted(whole.collect()) == sorted(got.values())
    assert K.percentiles(K.bucketed(df.limit(0), ["key"], "value"), ["key"], SHARES).collect() == []


def test_distinct_counts_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("slot"), (F.col("id") * 31 % 20_000).alias("v"))
    slots = K.distinct_sketches(df.unionByName(spark.createDataFrame([(0, None)], "slot long, v long")), ["slot"], "v")
    n = K.distinct_counts(slots.withColumn("all", F.lit(1)), ["all"]).first()["n_distinct"]
    assert abs(n - 20_000) <= 4 * 1.04 / math.sqrt(2**K.REGISTERS_LOG2) * 20_000
    assert n == K.distinct_counts(K.distinct_sketches(df.withColumn("all", F.lit(1)), ["all"], "v"), ["all"]).first()["n_distinct"]


def test_weekly_users_are_near_the_exact_count(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    want = {(r["event_type"], r["week"]): r["n"] for r in e.groupBy("event_type", "week").agg(F.count_distinct("user_id").alias("n")).collect()}
    got = {(r["event_type"], r["week"]): r["n_distinct"] for r in plan.weekly_users(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - n) <= max(1, 0.065 * n) for k, n in want.items())
