"""What a worker or reader holds at a time is bounded by bytes or rows, not by the size of a task's input."""

from pyspark.sql import functions as F

from quern.llm import phrases
from quern.operators import patch
from quern.sources.scratch import Scratch


def test_diffs_are_made_in_slices_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(patch, "SLICE", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 300] * 20)], ["text"])
    parts = list(patch._sliced(batch))
    assert len(parts) > 5 and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert [len(p) for p in patch._sliced(pa.RecordBatch.from_arrays([pa.array(["x" * 9999] * 2)], ["text"]))] == [1, 1]


def test_a_file_of_chunks_holds_few(spark):
    rows = spark.range(50).coalesce(1).select("id")
    table = Scratch(spark, "rows").table(rows, phrases.FILE_CHUNKS)
    most = table.groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0]
    assert table.count() == 50 and most <= phrases.FILE_CHUNKS
