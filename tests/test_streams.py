import datetime
import random

import pandas as pd

from quern.streaming.streams import LastSent, bounded_sets, drained, newest_sets, repeated_reads


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Handle:
    """Stands in for the engine's state: one value a key and name."""

    def __init__(self):
        self.ttl = None

    def getValueState(self, name, schema, ttl):  # noqa: N802
        self.ttl, self.value = ttl, Value()
        return self.value


def test_repeated_reads_are_known_over_batches():
    handle, processor = Handle(), LastSent()
    processor.init(handle)
    assert handle.ttl == 300_000
    batches = [[(2, "x"), (1, "x")], [(3, "x")], [(5, "y"), (4, "x")]]
    got = []
    for batch in batches:
        rows = iter([pd.DataFrame(batch, columns=["seq", "content"])])
        got += [tuple(r) for out in processor.handleInputRows(("a", "f"), rows, None) for r in out.itertuples(index=False)]
    assert got == [("a", "f", 1, False, False), ("a", "f", 2, True, True), ("a", "f", 3, True, True), ("a", "f", 4, True, True), ("a", "f", 5, True, False)]


def test_a_run_of_repeated_reads_ends_and_remembers_between_batches(spark, tmp_path):
    kind = "agent_id string, file string, seq long, content string"
    for k, rows in enumerate([[("a", "f", 1, "x"), ("b", "f", 2, "x")], [("a", "f", 3, "x"), ("a", "g", 4, "x")], [("a", "f", 5, "y")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    reads = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = drained(repeated_reads(reads), closing=False)
    assert sorted((r["seq"], r["seen"], r["same"]) for r in out.collect()) == [(1, False, False), (2, False, False), (3, True, True), (4, False, False), (5, True, False)]


def test_bounded_sets_are_those_of_all_batches_in_any_order(spark, tmp_path):
    r = random.Random(2)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(r.choice(["p", "p", "p", "q", None, f"r{r.randrange(30)}"]), f"f{r.randrange(120)}", t0 + datetime.timedelta(seconds=r.randrange(4000)), 2**60 + i) for i in range(3000)]
    rows += [("p", None, t0, 1), ("q", "x", None, 2), ("q", "y", t0, None)]
    kind = "project string, file string, ts timestamp_ntz, event_id long"
    r.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = drained(bounded_sets(stream, 10), closing=False, rocksdb=True)
    assert out.agg({"version": "max"}).first()[0] == 4
    first = {}
    for project, file, ts, event in rows:
        if None not in (file, ts, event):
            own = first.setdefault(project, {})
            own[file] = min(own.get(file, (ts, event)), (ts, event))
    kept = sorted(first, key=lambda p: min(first[p].values()))[:5]
    want = {p: sorted(sorted(first[p], key=first[p].get)[:10]) for p in kept}
    assert {x["project"]: x["files"] for x in newest_sets(out, 5).collect()} == want
