import numpy as np
import pytest

from quern.operators import retrieval as R
from quern.operators.cells import Cells
from quern.plans import retrieval as P
from quern.plans import views as V

SCHEMA = "key string, tags array<string>, project string, created_at timestamp_ntz, embedding array<double>"


def memory(spark, rows):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, tags, p, t, e) for k, tags, p, e in rows], SCHEMA)


def both(spark, tmp_path, rows, queries, k):
    m = memory(spark, rows)
    v = m.select("project", "key", "embedding")
    index = Cells(spark, f"file://{tmp_path}/cells").build(m, v)
    assert index.exists()
    for project, q in queries:
        one = spark.createDataFrame([(q,)], "qvec array<double>")
        want = R.top(R.knn_ranked(m, v, project, one), k).collect()
        assert index.top(project, one, k).collect() == want
    return index


def test_the_index_of_the_tables_reads_few_vectors(spark):
    """At sf0.1 against brute force; fewer than a tenth of the project's vectors are read."""
    sf = "/root/testdata/sf0.1"
    m, v, q = V.memory(spark, sf), V.vectors(spark, sf), P._vector(spark, sf)
    index = P.vector_index(spark, sf)
    want = R.top(R.knn_ranked(m, v, P.PROJECT, q), 20).collect()
    assert index.top(P.PROJECT, q, 20).collect() == want
    read = index.candidates(P.PROJECT, q.first()["qvec"], 20).count()
    assert 20 <= read < v.filter(v["project"] == P.PROJECT).count() / 10


def test_odd_vectors_and_queries(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [[0.0, 0.0], None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0, 0.0], [1e-200, 1e-200], [1e200, 1e200], [1.0, 1.0], [1.0, 1.0]]
    rows = [(f"k{i:02d}", ["roi"] if i == 10 else [], "p", e) for i, e in enumerate(odd)] + [("k09", [], "q", [-1.0, 1.0])]
    queries = [(p, q) for p in ("p", "q", "none") for q in ([1.0, 0.5], [0.0, 0.0], None, [nan, 1.0], [1.0, 2.0, 3.0], [1e200, 1e200], [])]
    both(spark, tmp_path, rows, queries, 3)


def test_an_empty_table(spark, tmp_path):
    both(spark, tmp_path, [], [("p", [1.0, 2.0])], 5)


@pytest.mark.parametrize("k", [1, 20, 500])
def test_groups_copies_and_ties_against_brute_force(spark, tmp_path, k, monkeypatch):
    from quern.operators import cells

    monkeypatch.setattr(cells, "LOOKED_UP", 100)
    rng = np.random.default_rng(k)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.1 * rng.standard_normal((1500, 16))
    x[300:600] = x[0]  # a large group of copies
    x[600:700] = 3 * x[1]
    rows = [(f"k{i:04d}", ["roi"] if i % 9 == 0 else [], "pq"[i % 7 == 0], e.tolist()) for i, e in enumerate(x)]
    queries = [("p", x[5].tolist()), ("p", x[0].tolist()), ("q", rng.standard_normal(16).tolist())]
    index = both(spark, tmp_path, rows, queries, k)
    if k == 20:
        assert index.candidates("p", x[5].tolist(), k).count() < 150
