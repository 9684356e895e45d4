"""Sessions are found without their files, which are joined by slots: no set grows with a session inside the merge."""

import datetime

from pyspark.sql import functions as F

from quern.streaming import streams as S


def test_sessions_over_slots_and_at_the_gap(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    # one session over three slots with gaps of just ten seconds, a second one microsecond too late, and what closes both
    rows = [("p", "a", at(9)), ("p", "b", at(19)), ("p", "c", at(29)), ("p", "d", at(39) + datetime.timedelta(microseconds=1)), ("p", "d", at(40)),
            ("p", "e", at(45)), ("q", "x", at(9)), ("q", "x", at(10)), ("p", "z", at(1000))]
    spark.createDataFrame(rows, "project string, file string, ts timestamp_ntz").write.parquet(f"{tmp_path}/m")
    stream = lambda: S.file_stream(spark, f"{tmp_path}/m", "*.parquet", spark.read.parquet(f"{tmp_path}/m").schema)
    bounds = S.session_bounds(stream(), "10 seconds")
    assert "files" not in bounds.columns and "collect_set" not in bounds._jdf.queryExecution().analyzed().toString()
    out = S.change_sets(S.drained(bounds), S.drained(S.slot_files(stream(), "10 seconds")), "10 seconds")
    found = {(r[0], r[1], tuple(r[2])) for r in out.select("project", F.date_format("session_start", "mm:ss"), "files").collect()}
    assert found == {("p", "00:09", ("a", "b", "c")), ("p", "00:39", ("d", "e"))}
