"""Lock requests replayed in order, with the requests of one file spread over many tasks.

All requests are cut into slices of about equal size by (file, time), so a file with a third of all requests lies in
many slices. A slice that lies within one file becomes a transition of the lease that is held when it begins: such a
lease ends at its holder's first unlock or at the first request after it has run out, and what follows a free lock
depends on the slice alone. Transitions are applied to each other along a file, one row a slice, which gives the lease
that each slice begins with; then all slices are replayed apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.scratch import Scratch

LEASE_MINUTES = 30
#: Time of requests that have none: before all others, so that no lease of theirs outlives the first that has one.
TIMELESS = -(2**62)

Lease = tuple[str, int] | None


class Transition:
    """Of one file in one slice, built from its last request to its first.

    ``free`` is the lease at the end if the lock is free before the requests added so far. ``runs`` holds the same
    for a lock that becomes free at the first request after some time: (time, lease at the end), the latest first, one
    entry for requests in a row that agree. ``freed`` holds each agent's next unlock and the lease at the end after it.
    """

    def __init__(self, lease: int, runs: list | None = None, freed: dict | None = None):
        self.lease = lease
        self.free: Lease = None
        self.runs: list[tuple[int, Lease]] = runs or []
        self.freed: dict[str, tuple[int, Lease]] = freed or {}
        self._room = 1024

    def after(self, held: Lease) -> Lease:
        """The lease at the end if ``held`` is held before all requests."""
        if held is None:
            return self.free
        over = held[1] + self.lease
        at, then = self.freed.get(held[0], (None, None))
        if at is not None and at <= over:
            return then
        first = bisect_left(self.runs, -over, key=lambda r: -r[0])
        return self.runs[first - 1][1] if first else held

    def add(self, agent: str | None, us: int, unlock: bool) -> None:
        """The request before all that were added. One without an agent changes no lease."""
        if agent is not None and unlock:
            self.freed[agent] = (us, self.free)
        elif agent is not None:
            self.free = self.after((agent, us))
        if self.runs and self.runs[-1][0] == us:
            self.runs.pop()
        if not self.runs or self.runs[-1][1] != self.free:
            self.runs.append((us, self.free))
        if len(self.runs) + len(self.freed) > self._room:
            self.forget(us)
            self._room = 2 * (len(self.runs) + len(self.freed)) + 1024

    def forget(self, us: int) -> None:
        """Drops what no lease of this time or before can need."""
        first = bisect_left(self.runs, -(us + self.lease), key=lambda r: -r[0])
        del self.runs[: max(0, first - 1)]
        self.freed = {a: x for a, x in self.freed.items() if x[0] <= us + self.lease}


_STATE = [T.StructField("at", T.LongType()), T.StructField("agent", T.StringType()), T.StructField("since", T.LongType())]
_SUMMARY = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("slice", T.IntegerType()), T.StructField("begins", T.BooleanType()),
    T.StructField("whole", T.BooleanType()), *_STATE[1:], T.StructField("runs", T.ArrayType(T.StructType(_STATE))),
    T.StructField("freed", T.ArrayType(T.StructType([T.StructField("of", T.StringType()), *_STATE]))),
])


def _summaries(sliced: DataFrame, slices: int, lease: int) -> DataFrame:
    """Of each slice: the file that goes on from it, with its transition, and the file that it begins with."""
    rows = sliced.select("__slice", F.col("file_path").alias("file"), "agent_id", "__us", "__unlock", "event_id")
    back = [F.col(c).desc() for c in ("file", "__us", "event_id", "agent_id", "__unlock")]
    ordered = rows.repartition(slices, "__slice").sortWithinPartitions("__slice", *back)

    def named(state: Lease) -> dict:
        return {"agent": state and state[0], "since": state and state[1]}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(_SUMMARY)
        found: list[dict] = []
        now, last, file, first_us, t = None, None, None, 0, Transition(lease)

        def close() -> None:
            """The slice that ends here: ``last`` is the file that was met first, ``file`` the one met last."""
            one = t is not None
            if one:
                keep(True)
            else:
                found.append({"file": file, "slice": now, "begins": True, "whole": False, "runs": [], "freed": [], **named(None)})

        def keep(whole: bool) -> None:
            t.forget(first_us)
            runs = [{"at": at, **named(s)} for at, s in t.runs] if whole else []
            freed = [{"of": a, "at": at, **named(s)} for a, (at, s) in t.freed.items()] if whole else []
            found.append({"file": last, "slice": now, "begins": whole, "whole": whole, "runs": runs, "freed": freed, **named(t.free)})

        for batch in batches:
            for s, f, agent, us, unlock in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if s != now:
                    if now is not None:
                        close()
                    now, last, file, t = s, f, f, Transition(lease)
                elif f != file:
                    if t is not None:
                        keep(False)
                    file, t = f, None
                if t is not None:
                    t.add(agent, us, unlock)
                    first_us = us
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=kinds)
                found.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist(found, schema=kinds)

    return ordered.mapInArrow(run, _SUMMARY)


def _entries(summaries: DataFrame, lease: int) -> DataFrame:
    """(slice, holder, since): the lease that a slice's first file has when the slice begins; none where it is free."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        file, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, held = row["file"], None
                if row["begins"] and held is not None:
                    out.append((row["slice"], *held))
                free = None if row["agent"] is None else (row["agent"], row["since"])
                if not row["whole"]:
                    held = free
                    continue
                state = lambda x: None if x["agent"] is None else (x["agent"], x["since"])
                t = Transition(lease, [(x["at"], state(x)) for x in row["runs"]], {x["of"]: (x["at"], state(x)) for x in row["freed"]})
                t.free = free
                held = t.after(held)
            names = ("slice", "holder", "since")
            kinds = (pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(3)], names=list(names))

    ordered = summaries.repartition("file").sortWithinPartitions("file", "slice")
    return ordered.mapInArrow(run, "slice int, holder string, since bigint")


def _leases(requests: DataFrame, unlock: F.Column, added: str, answer: Callable, minutes: int, slices: int | None) -> DataFrame:
    """requests (file_path, agent_id, ts, event_id, ...) with what ``answer`` says of each and the lease before it.

    answer(agent, unlock, holder) gives the new columns and the holder after the request; a holder whose lease is over
    is none. Columns of requests pass through as they are.
    """
    spark = requests.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lease = minutes * 60 * 1_000_000
    own = [f.name for f in requests.schema]
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(TIMELESS))
    rows = requests.withColumn("__us", us).withColumn("__unlock", F.coalesce(unlock, F.lit(False)))
    scratch = Scratch(spark, "leases")
    cut = rows.repartitionByRange(slices, "file_path", "__us", "event_id").withColumn("__slice", F.spark_partition_id())
    sliced = scratch.table(cut)
    entries = scratch.table(_entries(_summaries(sliced, slices, lease), lease))
    # at most one row a slice
    begun = F.broadcast(entries.select(F.col("slice").alias("__slice"), F.col("holder").alias("__holder"), F.col("since").alias("__since")))
    order = ("__slice", "file_path", "__us", "event_id", "agent_id", "__unlock")
    ordered = sliced.join(begun, "__slice", "left").repartition(slices, "__slice").sortWithinPartitions(*order)
    names, kinds = zip(*(x.split() for x in added.split(", ")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [{"string": pa.string(), "boolean": pa.bool_()}[k] for k in kinds]
        now, file, holder, since = None, None, None, 0
        for batch in batches:
            found = []
            for s, f, agent, us, unlock, held, began in zip(*(batch.column(c).to_pylist() for c in ("__slice", "file_path", "agent_id", "__us", "__unlock", "__holder", "__since"))):
                if s != now:
                    now, file, holder, since = s, f, held, began
                elif f != file:
                    file, holder = f, None
                if holder is not None and us - since > lease:
                    holder = None
                values, after = answer(agent, unlock, holder)
                found.append(values)
                since = us if holder is None else since
                holder = after
            new = [pa.array([x[k] for x in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], [*own, *names])

    before = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    return ordered.mapInArrow(run, f"{before}, {added}")


def lock_answers(requests: DataFrame, minutes: int = LEASE_MINUTES, slices: int | None = None) -> DataFrame:
    """requests (file_path, agent_id, ts, event_id, ...) with holder (after them) and answer: acquired (the file was
    free, or its lease over), already_held (by the same agent, which prolongs nothing) or locked.

    Requests are taken by ts, then event_id; without a ts they come first. One without an agent acquires a free lock
    and leaves it free. Null files are one file. slices: into how many tasks all requests are cut (default: the
    session's shuffle partitions).
    """

    def answer(agent: str | None, unlock: bool, holder: str | None) -> tuple[tuple, str | None]:
        if holder is None:
            return (agent, "acquired"), agent
        return (holder, "already_held" if holder == agent else "locked"), holder

    return _leases(requests, F.lit(False), "holder string, answer string", answer, minutes, slices)


def replay_locks(requests: DataFrame, minutes: int = LEASE_MINUTES, slices: int | None = None) -> DataFrame:
    """requests (file_path, agent_id, ts, event_id, action lock/unlock, ...) with granted, replayed as ``lock_answers``.

    A lock is free, held or expired when a request comes; holding again does not prolong it; unlocking is for the
    holder.
    """

    def answer(agent: str | None, unlock: bool, holder: str | None) -> tuple[tuple, str | None]:
        own = holder == agent
        if unlock:
            return (own,), None if own else holder
        return (holder is None or own,), agent if holder is None else holder

    return _leases(requests, F.col("action") == "unlock", "granted boolean", answer, minutes, slices)
