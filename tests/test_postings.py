import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import postings as P
from quern.operators import retrieval as R
from quern.sources.scratch import Scratch

SCHEMA = "key string, content string, tags array<string>, project string, created_at timestamp_ntz, agent_id string"
T0 = datetime.datetime(2024, 1, 1)
QUERIES = ["alpha", "Running betas", "the the alpha gamma", "alpha missing", "..."]


def records(seed, n, offset=0):
    rng = random.Random(seed)
    words = ["the"] * 9 + ["alpha", "alphas", "beta", "running", "run", "gamma", "Été"] + [f"w{i}" for i in range(60)]
    text = lambda: None if rng.random() < 0.03 else " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 20, 200])))
    tags = lambda: rng.choice([None, [], ["x"], ["roi"]])
    return [(f"k{(i + offset):04d}", text(), tags(), rng.choice(["p", "p", "q"]), T0 + datetime.timedelta(minutes=i), "a") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def index(spark, memory, **options):
    return P.Postings(spark, Scratch(spark, "test-index").root).build(memory, **options)


def assert_same(spark, built, memory, queries=("the alpha",), k=20):
    for q in queries:
        want = R.top(R.bm25_ranked(memory, "p", q), k, F.col("created_at").desc()).collect()
        assert R.bm25_top(memory, "p", q, k, F.col("created_at").desc(), index=built).collect() == want, q


def test_top_k_equals_ranking_every_record(spark):
    memory = frame(spark, records(1, 400))
    assert_same(spark, index(spark, memory, block=16), memory, QUERIES, 5)


def test_updates_are_generations_and_older_files_stay(spark):
    rows = {(r[3], r[0]): r for r in records(2, 200)}
    built = index(spark, frame(spark, list(rows.values())), block=32)
    files = lambda: {f for f in frame_files(spark, built.root) if "/gen=0/" in f}
    before = files()
    for seed, offset in ((3, 150), (4, 190)):
        new = {(r[3], r[0]): r for r in records(seed, 60, offset)}
        rows |= new
        built.add(frame(spark, list(new.values())))
    gone = [k for k in rows if k[1] < "k0030"] + [("p", "nowhere")]
    built.remove(spark.createDataFrame(gone, "project string, key string"))
    rows = {k: r for k, r in rows.items() if k not in gone}
    assert files() == before and len(built.generations()) == 4
    assert_same(spark, built, frame(spark, list(rows.values())))
    assert_same(spark, P.Postings(spark, built.root), frame(spark, list(rows.values())))


def frame_files(spark, root):
    return spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", "*.parquet").load(root).select("path").toPandas()["path"].tolist()


def test_a_writer_that_was_lost_leaves_nothing(spark):
    memory = frame(spark, records(5, 100))
    built = index(spark, memory)
    frame(spark, records(6, 5)).select("project", "key", F.lit(3).alias("dl")).write.parquet(f"{built.root}/docs/gen=1")
    assert_same(spark, built.refresh(), memory)
    with pytest.raises(ValueError):
        built.build(memory)


def test_a_query_reads_its_buckets_and_terms_and_opens_few_slices(spark):
    rows = [(f"k{i:05d}", "the alpha " + "w " * (i % 300), [], "p", T0, "a") for i in range(3000)]
    built = index(spark, frame(spark, rows), block=1000, buckets=16)
    terms = R.analyze("the alpha")
    stats = built.statistics(terms)
    score = [lambda tf, dl, df=df: P.bm25(tf, dl, F.lit(df), F.lit(stats.n), F.lit(stats.avgdl)) for df in stats.df]
    shown = built.blocks(terms).filter("project = 'p' and visible")
    opened, there = built.slices_to_open(shown, terms, score, 20).count(), shown.select("slice").distinct().count()
    assert 0 < opened < there / 2
    plan = built.top("p", terms, 20)._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan and re.search(r"PartitionFilters: \[[^]]*bucket#", plan) and re.search(r"PushedFilters: \[[^]]*In\(term", plan)


def test_empty_tables(spark):
    built = index(spark, frame(spark, []))
    assert built.top("p", ["alpha"], 5).count() == 0 and built.statistics(["alpha"]).n == 0
    rows = records(7, 30)
    assert_same(spark, built.add(frame(spark, rows)), frame(spark, rows))
