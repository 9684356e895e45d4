import random
from collections import Counter

import pytest
import xxhash

from quern.llm.components import connected_components
from quern.llm.simhash import drop_near_duplicates, near_duplicates, neighbours
from tests.llm.cases import frame, odd_documents


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


def brute(rows, radius=2):
    fps = [fingerprint(r[1]) for r in rows]
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    root = roots(len(fps), edges)
    least = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return Counter((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(rows, fps, root))


def test_odd_documents_against_brute_force(spark):
    got = near_duplicates(frame(spark)).drop("fp").collect()
    assert Counter(map(tuple, got)) == brute(odd_documents())
    assert near_duplicates(frame(spark, [])).collect() == []


def test_near_copies_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        words = [r.choice("abcdefghij") * r.randrange(1, 40) for _ in range(400)]
        for j in range(3):
            words[r.randrange(400)] = "changed"
            rows.append((3 * i + j, " ".join(words), None, None, None, None, None, None, None, None))
    got = near_duplicates(frame(spark, rows)).drop("fp").collect()
    want = brute(rows)
    assert Counter(map(tuple, got)) == want
    assert any(k[0] != k[2] for k in want)


def test_no_pair_within_the_radius_is_lost(spark):
    r = random.Random(1)
    fps = {0, 2**64 - 1}
    for _ in range(150):
        f = r.getrandbits(64)
        fps |= {f, f ^ 1 << r.randrange(64), f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), f ^ 7 << r.randrange(60)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    place = {s: i for i, s in enumerate(signed)}
    edges = neighbours(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert all((fps[place[e[0]]] ^ fps[place[e[1]]]).bit_count() <= 2 for e in edges)
    assert roots(len(fps), [(place[a], place[b]) for a, b in edges]) == roots(len(fps), want)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 20)] + [(30, 31), (31, 30), (None, 3)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    pairs = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    root = roots(40, pairs)
    assert got == {n: root[n] for n in {x for p in pairs for x in p}}


def test_drop_keeps_one_of_a_group(spark):
    docs = frame(spark).filter("doc_id is not null")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    want = {k[2] for k in brute([r for r in odd_documents() if r[0] is not None])}
    assert {r["doc_id"] for r in out.collect()} == want
