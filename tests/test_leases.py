import datetime
import random

from pyspark.sql import functions as F

from quern.operators import leases

T0 = datetime.datetime(2024, 1, 1)
KIND = "file_path string, agent_id string, ts timestamp_ntz, event_id long, action string"


def log(n, files, span, seed, agents=4):
    """Requests of which half are for one file; ties in time, requests without agent, file or time."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        file = "hot" if r.random() < 0.5 else r.choice(files)
        agent = None if r.random() < 0.05 else f"a{r.randrange(agents)}"
        ts = None if r.random() < 0.02 else T0 + datetime.timedelta(seconds=r.randrange(span))
        rows.append((file, agent, ts, 2**60 + i, r.choice(["lock", "lock", "unlock", None])))
    return rows


def replayed(rows, minutes, unlocks=True):
    """By event: what a loop over each file's requests says."""
    out, held = {}, {}
    for file, agent, ts, event, action in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[2] is not None, x[2] or T0, x[3])):
        holder, since = held.get(file, (None, None))
        if holder is not None and (ts is not None and (since is None or ts - since > datetime.timedelta(minutes=minutes))):
            holder = None
        if unlocks and action == "unlock":
            out[event] = holder == agent
            held[file] = (None, None) if holder == agent else (holder, since)
            continue
        out[event] = holder is None or holder == agent
        if not unlocks:
            out[event] = (agent, "acquired") if holder is None else (holder, "already_held" if holder == agent else "locked")
        held[file] = (agent, ts) if holder is None else (holder, since)
    return out


def test_slices_change_nothing(spark):
    for n, span, agents, slices in ((600, 100_000, 4, 7), (600, 600, 3, 16), (500, 20_000, 40, 40), (60, 5_000, 2, 50), (1, 10, 1, 4)):
        rows = log(n, ["f", "g", None, "z"], span, n + span + slices, agents)
        df = spark.createDataFrame(rows, KIND)
        got = {r["event_id"]: r["granted"] for r in leases.replay_locks(df, slices=slices).collect()}
        assert got == replayed(rows, 30)
        got = {r["event_id"]: (r["holder"], r["answer"]) for r in leases.lock_answers(df, 5, slices).collect()}
        assert got == replayed(rows, 5, unlocks=False)
    assert leases.replay_locks(spark.createDataFrame([], KIND)).collect() == []


def test_a_hot_file_is_spread(spark):
    rows = [("hot", f"a{i % 5}", T0 + datetime.timedelta(seconds=i // 3), i, "lock" if i % 3 else "unlock") for i in range(4000)]
    df = spark.createDataFrame(rows, KIND)
    out = leases.replay_locks(df, slices=16)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 1000 and len(sizes) >= 6
    assert {r["event_id"]: r["granted"] for r in out.collect()} == replayed(rows, 30)


def test_a_transition_forgets_what_no_lease_can_need():
    minute = 60_000_000
    t = leases.Transition(30 * minute)
    for i in reversed(range(50_000)):
        t.add(f"a{i % 7000}", i * minute // 4, i % 2 == 0)
    t.forget(0)
    assert len(t.runs) + len(t.freed) < 400
