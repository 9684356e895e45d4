import re
from collections import Counter, defaultdict

import pytest

from quern.llm.mixing import mix, mix_table, source_targets
from tests.llm.cases import frame, odd_documents


def fill(sizes, weights, share=1.5, most=2.0):
    """Reshares the excess by weight, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in names if s not in full]
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = 0.0
        for s in free:
            over = target[s] - most * sizes[s]
            if over >= -1e-12:
                left, target[s] = left + max(0.0, over), most * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, None: 100}, {"a": 5, "b": 1000, "c": 7, "d": 0}, {"x": 10}, {"a": 0}])
def test_targets_are_those_of_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == pytest.approx(fill(sizes, (5, 2, 1)))


def test_odd_documents(spark):
    rows = mix_table(frame(spark)).collect()
    want = Counter((r[0], len(re.findall(r"[^ \t-\r]+", r[1] or ""))) for r in odd_documents())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == want
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2 for r in rows)


def test_taken_is_within_half_a_document_of_the_target(spark):
    docs = [(i, "w " * (i % 40 + 1), None, f"s{i % 7}", None, None, None, None, None, None) for i in range(2000)]
    rows = mix_table(frame(spark, docs)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source_size"], r["target"]].append(r["taken"])
    assert len(by) == 7
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 20
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mix_table(frame(spark, docs[::-1])).collect()))


def test_budgets_are_nested(spark):
    docs = frame(spark, [(i, "w " * (i % 9 + 1), None, "s", None, None, None, None, None, None) for i in range(500)])
    some = {r["doc_id"] for r in mix_table(docs, share=0.3).collect() if r["copies"]}
    more = {r["doc_id"] for r in mix_table(docs, share=0.6).collect() if r["copies"]}
    assert some < more


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = frame(spark)
    copies = Counter(r["doc_id"] for r in mix_table(docs).collect() for _ in range(r["copies"]))
    out = mix(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == copies
    assert mix(frame(spark, [])).collect() == [] and mix_table(frame(spark, [])).collect() == []
