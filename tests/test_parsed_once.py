"""Files are parsed once and by as many tasks as there are shuffle partitions, however small their table is."""

from quern.operators import code as C
from quern.plans import code


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_index_of_symbols_parses_files_once(spark):
    assert "MapInArrow" not in plan(code.symbol_index(spark, "/root/testdata/sf0.001"))


def test_parts_of_one_split_are_dealt_out(spark):
    files = code._files(spark, "/root/testdata/sf0.001")
    assert files.rdd.getNumPartitions() == C.tasks(spark) > 1


def test_a_refresh_parses_only_changed_files_and_deals_them_out(spark):
    shown = plan(code.symbol_refresh(spark, "/root/testdata/sf0.001"))
    assert shown.count("MapInArrow") == 1 and "hashpartitioning(path" in shown and "REPARTITION_BY_NUM" in shown
