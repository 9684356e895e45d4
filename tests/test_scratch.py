import os
from types import SimpleNamespace

import pytest

from quern.functions.names import column, columns, unused
from quern.sources import scratch


def test_tables_go_when_they_are_released(spark):
    own = scratch.Scratch(spark, "test")
    table = own.table(spark.range(3))
    assert table.count() == 3
    folder = own.root.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    scratch.release()
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_any_column_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `c``d` int, X int")
    assert [tuple(r) for r in df.select(*columns(df)).collect()] == [(1, 2, 3)]
    assert df.select(column("a.b")).first()[0] == 1
    assert unused(df.columns, "x", "y", "y") == ["_x", "y", "_y"]


def test_a_written_table_leaves_no_shuffle_files(spark):
    from quern.sources.scratch import CLEANED, Scratch

    count = lambda: len(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("shuffle_")) - 1
    before, set_before = count(), spark.conf.get(CLEANED)
    table = Scratch(spark, "test").table(spark.range(100_000).repartition(8, "id"))
    assert count() <= before and spark.conf.get(CLEANED) == set_before
    assert table.count() == 100_000
