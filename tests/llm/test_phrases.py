import random
import re
from collections import Counter

import numpy as np
import pytest

from quern.llm import phrases
from tests.llm.cases import SCHEMA, ascii_lower, frame, odd_documents


def brute(rows, least, most=2000):
    n, f = Counter(), {}
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\x0a-\x0d]", ascii_lower(r[1] or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cands.items():
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            inside = any(100 * b >= 80 * a for h, b in cands.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))))
            if not inside:
                found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, g, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, g.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def rows_of(seed, lines):
    rng = random.Random(seed)
    words = ["the", "of", "a\x01", "É", "é", "b#", "x"] + [f"w{i}" for i in range(12)]
    text = lambda: "".join(rng.choice(words[: rng.randint(2, 19)]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for _ in range(rng.randint(0, 60)))
    return [(i, text(), rng.choice(["en", "en", "fr", None]), "s", None, "", "", "", "", "") for i in range(lines)]


@pytest.mark.parametrize("least", [3, 30])
def test_phrases_agree_with_counting_all(spark, least):
    rows = rows_of(least, 150) + odd_documents() + [(7, "to be or not to be " * 40 + "the end", "en", "s", None, "", "", "", "", "")] * 3
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=least)
    assert sorted(map(tuple, found.collect())) == brute(rows, least)


def test_small_chunks_parts_and_buckets_change_nothing(spark, monkeypatch):
    rows = rows_of(5, 120)
    expected = brute(rows, 4, 25)
    monkeypatch.setattr(phrases, "PART_KEYS", 50)  # ranges cut most runs
    monkeypatch.setattr(phrases, "RANK_BUCKETS", 3)
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(9), least=4, most=25)
    assert sorted(map(tuple, found.collect())) == expected


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(phrases, "STEP", 40)
    text = ("one two three. four five, " * 30 + "endless " * 50).encode().translate(phrases._TABLE)
    parts = list(phrases._parts(text))
    assert b"".join(parts) == text and len(parts) > 10 and all(p.endswith(b"\xff") for p in parts[:-1])


def test_runs_cut_by_a_border_are_passed_on():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 4000).astype(np.uint32)
    hi, lo, n = phrases.packed_keys(ids)
    whole = {(int(h), int(x)): int(a) for h, x, a in zip(*phrases.phrase_runs(hi, lo, n, 1))}
    cut, sums = len(hi) // 2, Counter()
    for part in (slice(0, cut), slice(cut, None)):
        for h, x, a in zip(*phrases.phrase_runs(hi[part], lo[part], n[part], 40)):
            sums[int(h), int(x)] += int(a)
    assert {k: a for k, a in sums.items() if a >= 40} == {k: a for k, a in whole.items() if a >= 40}


def test_radix_order_is_the_order():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64) >> np.uint64(20)
    a[::3] = a[0]
    assert np.array_equal(phrases.radix_order(a, b), np.lexsort((b, a)))


def test_nothing_to_count(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None, None, None, "", "", "", "", ""), (2, "a b c", "en", None, None, "", "", "", "", "")])).count() == 0
