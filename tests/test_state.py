import datetime

from pyspark.sql import functions as F

from quern.operators import leases
from quern.operators import ledger as L
from quern.operators import state as S

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def ntz(t):
    return F.lit(t).cast("timestamp_ntz")


def test_decision_lifecycle(spark):
    d = spark.createDataFrame([(1, "p", ["a.rs", "b.rs"], T0), (2, "q", ["c.rs"], T0)], "id long, project string, governed_files array<string>, last_confirmed timestamp_ntz")
    confidence = lambda n: {r["id"]: (r["edit_count"], r["confidence"]) for r in S.edited_since(d, spark.createDataFrame([("a.rs", at(60 + i)) for i in range(n)], "file string, ts timestamp_ntz"), 30).collect()}
    assert confidence(1) == {1: (1, 0.9), 2: (0, 1.0)}
    assert confidence(16) == {1: (16, 0.1), 2: (0, 1.0)}
    decayed = S.edited_since(d, spark.createDataFrame([("a.rs", at(60))] * 3, "file string, ts timestamp_ntz"), 30)
    confirms = spark.createDataFrame([(1, "other"), (2, "q")], "id long, project string")
    got = {r["id"]: (r["edit_count"], r["confidence"]) for r in S.confirmed(decayed, confirms, ntz(at(99))).collect()}
    assert got == {1: (3, 0.7), 2: (0, 1.0)}  # the other project's confirmation is ignored


def test_edits_over_slot_borders_and_at_the_ends_of_the_range(spark):
    step = 2 * 86400
    d = spark.createDataFrame([(1, ["f"], at(step - 1))], "id long, governed_files array<string>, last_confirmed timestamp_ntz")
    times = [step - 1, step, 2 * step - 1, 2 * step, 2 * step + 1]
    e = spark.createDataFrame([("f", at(s)) for s in times], "file string, ts timestamp_ntz")
    assert S.edited_since(d, e, 2).first()["edit_count"] == 2


def test_locks_are_granted_one_at_a_time(spark):
    log = [("f", "a", 0, "lock"), ("f", "b", 1, "lock"), ("f", "b", 2, "unlock"), ("f", "a", 3, "unlock"), ("f", "b", 4, "lock"), ("f", "b", 5, "lock"), ("f", "a", 5 + 1801, "lock"), ("g", "a", 0, "lock")]
    df = spark.createDataFrame([(p, a, at(s), i, x) for i, (p, a, s, x) in enumerate(log)], "file_path string, agent_id string, ts timestamp_ntz, event_id long, action string")
    got = {r["event_id"]: r["granted"] for r in leases.replay_locks(df).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: True}
    held = {r["event_id"]: r["answer"] for r in leases.lock_answers(df.filter("action = 'lock'")).collect()}
    assert held == {0: "acquired", 1: "locked", 4: "locked", 5: "locked", 6: "acquired", 7: "acquired"}


def test_sets_stay_bounded(spark):
    rows = [(i, "p", f"f{i:03d}", at(i)) for i in range(100)] + [(1000 + i, f"q{i:02d}", "x", at(1000 + i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, project string, file string, ts timestamp_ntz")
    got = {r["project"]: r["files"] for r in S.bounded_sets(df).collect()}
    assert len(got) == 20 and got["p"] == [f"f{i:03d}" for i in range(50)]


def test_sessions_do_not_depend_on_slots(spark):
    import random

    r = random.Random(0)
    seconds, t = [], 0
    for _ in range(400):
        t += r.choice([0, 1, 5, 10, 11, 12, 60])
        seconds.append(t)
    df = spark.createDataFrame([(i, "k" if i % 3 else "l", f"f{i}", at(s)) for i, s in enumerate(seconds)], "event_id long, project string, file string, ts timestamp_ntz")
    want = {}
    for key in "kl":
        own = [(s, i) for i, s in enumerate(seconds) if ("k" if i % 3 else "l") == key]
        start = before = None
        for s, i in own:
            start = s if before is None or s - before > 10 else start
            want[i], before = at(start), s
    for slot in (7, 50, 86_400):
        assert {x["event_id"]: x["session_start"] for x in S.sessions(df, "project", 10, slot).collect()} == want


def test_upsert_keeps_the_last_and_sums(spark):
    log = spark.createDataFrame([("p", "k", 1, "old", 5), ("p", "k", 2, None, None), ("p", "j", 1, "x", None)], "project string, key string, seq long, content string, saved long")
    got = {r["key"]: (r["content"], r["saved"]) for r in S.latest(log, ["project", "key"], ["seq"], ["content"], ["saved"]).collect()}
    assert got == {"k": (None, 5), "j": ("x", 0)}


def test_purge_twice_is_purge_once(spark):
    m = spark.createDataFrame([(i, ["roi"] if i % 2 else None, at(-86400 * i)) for i in range(60)], "key long, tags array<string>, created_at timestamp_ntz")
    once = S.purge_ledger(m, ntz(T0))
    assert {r["key"] for r in once.collect()} == {i for i in range(60) if i % 2 == 0 or i <= 30}
    assert S.purge_ledger(once, ntz(T0)).count() == once.count()


def test_ledger_totals(spark):
    rows = spark.createDataFrame([(None, "p", T0, 5, 10), (None, "p", T0, None, 10), ("a", "p", T0, 7, 0)], "agent_id string, project string, created_at timestamp_ntz, token_saved long, token_usage long")
    got = {(r["level"], r["agent_id"]): (r["total_saved"], r["total_usage"], r["pct"]) for r in L.with_percent(L.with_grand_total(rows)).collect()}
    assert got == {("group", None): (5, 20, 25.0), ("group", "a"): (7, 0, 0.0), ("total", None): (12, 20, 60.0)}
    assert L.narrowed(rows, "2024-01-31 00:00:00", "year").count() == 0


def test_lock_requests_pass_through_unchanged(spark):
    big = 2**60 + 1
    rows = [("f", "a", at(0), big, None), ("f", "b", at(1), big + 1, 7), (None, None, at(2), None, 2**60 + 3)]
    df = spark.createDataFrame(rows, "file_path string, agent_id string, ts timestamp_ntz, event_id long, other long")
    got = leases.lock_answers(df)
    assert sorted(map(repr, got.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    assert {r["event_id"]: r["answer"] for r in got.collect()} == {big: "acquired", big + 1: "locked", None: "acquired"}

