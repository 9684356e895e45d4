"""Structured Streaming twins of the event operators. Sources are folders of files; nothing is lost on overflow.

Each function takes a streaming DataFrame and returns one; ``drained`` runs one over all input that is there and
returns what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.sources.scratch import Scratch

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
FILES_PER_TRIGGER = 100
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files: int = FILES_PER_TRIGGER) -> DataFrame:
    """New files of a folder, at most ``files`` in a batch: a slow reader holds the source back instead of losing events.

    Event times become TIMESTAMP, which watermarks need.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name)
    return reader.parquet(folder)


def timed(events: DataFrame, lateness: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def session_bounds(modified: DataFrame, gap: str = "2 seconds", lateness: str = "1 minute") -> DataFrame:
    """(project, start, end) of sessions of (project, file, ts): one closes when the watermark passes its gap. Without files, as a set
    that grows with a session is copied for each row that is merged into it."""
    session = F.session_window("ts", gap)
    return timed(modified, lateness).groupBy(session.alias("w"), "project").agg(F.count(F.lit(1)).alias("n")).select("project", "w.start", "w.end")


def slot_files(modified: DataFrame, gap: str = "2 seconds", lateness: str = "1 minute") -> DataFrame:
    """(project, slot, files) by slots of the gap's length: a slot's rows are of one session, so a project's rows are spread by slots."""
    slots = timed(modified, lateness).groupBy(F.window("ts", gap).alias("w"), "project").agg(F.collect_set("file").alias("files"))
    return slots.select("project", F.col("w.start").alias("slot"), "files")


def change_sets(bounds: DataFrame, slots: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """Files of a project modified together, from what ``session_bounds`` and ``slot_files`` of one stream wrote: the slots of a closed
    session are closed too. Rows that come later than the lateness may be missing."""
    length = F.expr(f"unix_micros(timestamp_seconds(0) + interval {gap})")
    number = lambda c: F.floor(F.unix_micros(c) / length)
    last = F.col("end") - F.expr(f"interval {gap}")
    own = bounds.select("project", F.col("start").alias("session_start"), F.explode(F.sequence(number(F.col("start")), number(last))).alias("number"))
    held = slots.select("project", number(F.col("slot")).alias("number"), F.explode("files").alias("file"))
    sets = own.join(held, ["project", "number"]).groupBy("project", "session_start").agg(F.collect_set("file").alias("files"))
    return sets.filter(F.size("files") > 1).select("project", "session_start", F.sort_array("files").alias("files"))


def window_counts(events: DataFrame, size: str, lateness: str = "1 hour") -> DataFrame:
    one = timed(events, lateness).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.col("w.start").alias("start"), "event_type", "n")


class LastSent(StatefulProcessor):
    """Per agent and file the last content that was sent, forgotten after a time to live; says if it is sent again."""

    TTL_MS = 300_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("content", T.StringType())]), self.TTL_MS)

    def handleInputRows(self, key, rows: Iterator, timers) -> Iterator:
        import pandas as pd

        reads = [r for pdf in rows for r in zip(pdf["seq"], pdf["content"])]
        known = self.last.get()[0] if self.last.exists() else None
        out = []
        for seq, content in sorted(reads):
            out.append((*key, seq, known is not None, known == content))
            known = content
        if known is not None:
            self.last.update((known,))
        yield pd.DataFrame(out, columns=["agent_id", "file", "seq", "seen", "same"])

    def close(self) -> None:
        pass


def repeated_reads(reads: DataFrame) -> DataFrame:
    """reads (agent_id, file, seq, content) with seen (sent before, within the time to live) and same. Needs ROCKSDB."""
    schema = "agent_id string, file string, seq long, seen boolean, same boolean"
    return reads.groupBy("agent_id", "file").transformWithStateInPandas(LastSent(), schema, "Append", "ProcessingTime")


class FirstFiles(StatefulProcessor):
    """Per project the files that were modified first, at most so many; each batch that brings a project rows says its set anew.

    A file leaves when enough others turn out to be earlier. What is kept only gets earlier, so the set is that of all
    rows so far, in whatever order they came.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        first = T.StructType([T.StructField("us", T.LongType()), T.StructField("event_id", T.LongType())])
        self.files = handle.getMapState("files", T.StructType([T.StructField("file", T.StringType())]), first)
        self.version = handle.getValueState("version", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator, timers) -> Iterator:
        import pandas as pd

        before = {file[0]: (first[0], first[1]) for file, first in self.files.iterator()}
        held = dict(before)
        for pdf in rows:
            for file, us, event in zip(pdf["file"], pdf["us"].tolist(), pdf["event_id"].tolist()):
                held[file] = min(held.get(file, (us, event)), (us, event))
            held = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[: self.most])
        for file in before.keys() - held.keys():
            self.files.removeKey((file,))
        for file, first in held.items():
            if before.get(file) != first:
                self.files.updateValue((file,), first)
        version = self.version.get()[0] + 1 if self.version.exists() else 1
        self.version.update((version,))
        us, event = min(held.values())
        yield pd.DataFrame({"project": [key[0]], "version": [version], "files": [sorted(held)], "first_us": [us], "first_id": [event]})

    def close(self) -> None:
        pass


def bounded_sets(modified: DataFrame, most_files: int = 50) -> DataFrame:
    """modified (project, file, ts, event_id) as growing sets (project, version, files, first_us, first_id); the newest version counts.

    Of a file's rows only the first counts, so each task sends one row a file and Arrow batch to the project's state, and
    a project with a third of all events costs its state little. Rows without file, ts or event_id do not count. Needs ROCKSDB.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = modified.select("project", "file", us.alias("us"), "event_id").dropna(subset=["file", "us", "event_id"])

    def firsts(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.sort_values(["us", "event_id"]).drop_duplicates(["project", "file"])

    thin = rows.mapInPandas(firsts, rows.schema)
    schema = "project string, version long, files array<string>, first_us long, first_id long"
    return thin.groupBy("project").transformWithStateInPandas(FirstFiles(most_files), schema, "Append", "None")


def newest_sets(sets: DataFrame, most_projects: int = 20) -> DataFrame:
    """(project, files, n_files) of what ``bounded_sets`` wrote, for the projects that were modified first."""
    last = sets.groupBy("project").agg(F.max_by(F.struct("files", "first_us", "first_id"), "version").alias("s")).select("project", "s.*")
    return last.orderBy("first_us", "first_id").limit(most_projects).select("project", "files", F.size("files").alias("n_files"))


NO_DATA, PROVIDER = "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame, mode: str = "append", closing: bool = True, rocksdb: bool = False) -> DataFrame:
    """Runs the stream over what its source has now. In complete mode the last batch's table is the result.

    closing: further batches without input close what a watermark has passed. State by processing time always asks for
    one more such batch, so a stream that holds any (``repeated_reads``) only ends without them. rocksdb: for the
    operators that need it, whatever the session's state store is.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, "stream")
    out, state = scratch.path(), scratch.path()
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).outputMode(mode)
    before = {name: spark.conf.get(name) for name in (NO_DATA, PROVIDER)}
    spark.conf.set(NO_DATA, str(closing).lower())
    if rocksdb:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
