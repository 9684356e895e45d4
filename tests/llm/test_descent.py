import numpy as np

from quern.llm import descent

SCHEMA = "vec_id long, embedding array<float>, label int, u string, score string, `a b` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", "y", 1) for i, e in rows], SCHEMA)


def brute(rows, every, k):
    ok = {(i, tuple(e)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    out = {}
    for i, e in ok:
        if i is not None and i % every == 0:
            near = [(float(np.dot(np.array(e, np.float64), np.array(f, np.float64))), j) for j, f in ok if j != i and len(f) == len(e)]
            out.setdefault(i, []).extend(sorted(near, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_odd_rows_and_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    grid = [[float(x) for x in v] for v in rng.integers(-3, 4, (90, 3))]  # ties, copies, zeros and lengths of all kinds
    rows = list(enumerate(grid)) + [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [1.0, float("nan"), 0.0]), (300, [float("inf"), 1.0, 0.0])]
    rows += [(None, [1.0, 2.0, 3.0]), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [5.0]), (0, grid[0])]
    rows += [(400 + k, [1.0, 1.0, 1.0]) for k in range(60)]
    assert found(descent.nearest(frame(spark, rows))) == {i: x for i, x in brute(rows, 20, 20).items() if x}
    assert descent.nearest(frame(spark, [])).count() == 0
    assert descent.nearest(frame(spark, [(20, None), (40, [0.0])])).count() == 0
    assert descent.nearest(frame(spark, [(20, [1.0, 2.0])])).count() == 0


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 32)).astype(np.float32)
    x[:1200] = x[0] + 0.05 * x[:1200]  # a dense group holds a third
    x *= rng.uniform(0.5, 2, (4000, 1)).astype(np.float32)
    got = found(descent.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])))
    e, hits = x.astype(np.float64), 0
    for i in range(0, 4000, 20):
        sims = e @ e[i]
        sims[i] = -np.inf
        hits += len({j for _, j in got[i]} & set(np.argsort(-sims)[:20].tolist()))
        assert all(abs(s - sims[j]) < 1e-9 for s, j in got[i]) and len(got[i]) == 20
    assert hits / (200 * 20) >= 0.9


def test_rounds_improve_the_graph(spark, monkeypatch):
    from quern.sources.scratch import Scratch

    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "u long, e array<double>")
    truth = np.argsort(-(x @ x.T), axis=1)[:, 1:21]

    def recall(rounds):
        monkeypatch.setattr(descent, "ROUNDS", rounds)
        scratch = Scratch(spark, "test")
        nodes = scratch.table(descent.nodes_of(classes, 24, 1.0))
        edges = descent.neighbour_graph(nodes, 3000, 25, scratch).toPandas()
        own = {u: set(g.sort_values("sim").v.tail(20)) for u, g in edges.groupby("u")}
        return np.mean([len(own[u] & set(truth[u])) / 20 for u in range(3000)])

    start, end = recall(0), recall(4)
    assert start < 0.8 and end > max(0.9, start + 0.15)
