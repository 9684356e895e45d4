import numpy as np
import pandas as pd
import pytest

from quern.llm.pivots import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, u long"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", None) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, least=0.9):
    n = len(vectors)
    x = [None if v is None or None in list(v) or not np.isfinite(np.array(v, float)).all() or not np.any(v) else np.array(v, np.float32).astype(float) for v in vectors]
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                links[i, j] = links[j, i] = x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= least
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(links[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    return {i: (int(links[i].sum()), root[i], root[i] == i) for i in range(n)}


def clustered(n, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, dims))
    return np.vstack([centres + rng.normal(size=centres.shape) * s for s in (0, 0.1, 0.2, 0.25, 2.0)])


def test_recall_and_no_false_links(spark):
    vectors = clustered(600)
    got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicate_vectors(frame(spark, vectors)).collect()}
    want = brute(vectors)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(x[0] for x in got.values()) >= 0.98 * sum(x[0] for x in want.values())


def test_pairs_at_the_limit_are_found_among_many_vectors(spark):
    """Recall of pairs with cosine 0.90 to 0.92, the hardest, with as many pivots as 20,000 vectors have."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, z = unit(rng.normal(size=(10_000, 32))), rng.normal(size=(10_000, 32))
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.901, 0.92, (len(x), 1))
    vectors = np.vstack([x, c * x + np.sqrt(1 - c * c) * z]).astype(np.float32)
    docs = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": vectors.tolist()}), "vec_id long, embedding array<float>")
    links = {r["vec_id"]: r["n_links"] for r in near_duplicate_vectors(docs).collect()}
    want = 0
    v = unit(vectors.astype(float))
    for i in range(0, len(v), 2000):
        want += int((v[i : i + 2000] @ v.T >= 0.9).sum()) - len(v[i : i + 2000])
    assert 0.93 * want <= sum(links.values()) <= want


def test_dealing_out_long_lists_changes_nothing(spark):
    rng = np.random.default_rng(4)
    vectors = np.vstack([clustered(600), rng.normal(size=32) + rng.normal(size=(700, 32)) * 0.1])
    rows = [sorted(map(tuple, near_duplicate_vectors(frame(spark, vectors), long=n).collect())) for n in (1 << 20, 200, 40)]
    assert rows[0] == rows[1] == rows[2]


def test_odd_vectors(spark):
    a, b = [1.0, 0, 0, 0], [0.95, 0.2, 0, 0]
    vectors = [a, a, a, b, None, [], [0, 0, 0, 0], [1, None, 0, 0], [float("nan"), 1, 0, 0], [float("inf"), 1, 0, 0], [1.0, 0], [2.0, 0], [0, 0, 0, 1e-30], [0, 0, 0, 1e30], [-1, 0, 0, 0]]
    got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicate_vectors(frame(spark, vectors)).collect()}
    assert got == brute(vectors)


def test_a_dense_group_is_counted_whole(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    vectors = np.vstack([centre + rng.normal(size=(1500, 16)) * 0.05, rng.normal(size=(50, 16))])
    got = {r["vec_id"]: tuple(r)[1:] for r in near_duplicate_vectors(frame(spark, vectors)).collect()}
    x = vectors.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert [got[i][0] for i in range(len(x))] == ((x @ x.T >= 0.9).sum(1) - 1).tolist()


@pytest.mark.parametrize("vectors,ids", [([], []), ([None, [0.0]], [1, 2]), ([[1.0], [1.0]], [5, 5])])
def test_small_tables(spark, vectors, ids):
    got = near_duplicate_vectors(frame(spark, vectors, ids)).collect()
    assert [r["vec_id"] for r in got] == ids
    if ids == [5, 5]:
        assert [(r["n_links"], r["component_id"], r["kept"]) for r in got] == [(1, 5, True)] * 2
