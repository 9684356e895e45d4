import math
import os
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quern.llm import lm
from tests.llm.cases import frame, odd_documents


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    tokens = [[*(r[1] or "").encode().lower().split(), b""] for r in rows]
    counts = Counter(w for r, t in zip(rows, tokens) if not held(r[0]) for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(r[0], held(r[0]), len(t), sum(w in counts for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for r, t in zip(rows, tokens)]


@pytest.mark.parametrize("settings", [{}, {"segment_grams": 50}, {"segment_grams": 50, "broadcast_bytes": -1}, {"segment_grams": 50, "met_rows": 1}])
def test_base_score_is_exact(spark, settings):
    rows = odd_documents() + [(k, f"word w{k % 3} w{k}", *[None] * 8) for k in range(20, 60)] + [(70, "very long " * 200_000, *[None] * 8)]
    got = sorted(((*r[:5], round(r[5], 6)) for r in lm.score_documents(frame(spark, rows), **settings).collect()), key=str)
    assert got == sorted(((*r[:5], round(r[5], 6)) for r in brute(rows)), key=str)
    assert lm.score_documents(frame(spark, [])).collect() == []


def test_every_score_follows_exact_counts(spark):
    """Each document's score against the same smoothing with exact counts of all n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in docs.collect()}
    grams = lambda words, n: zip(*([*[None] * k, *words] for k in range(n - 1, -1, -1)))
    train = [i for i in tokens if not held(i)]
    counts = [None] + [Counter(g for i in train for g in grams(tokens[i], n)) for n in (1, 2, 3)]
    total, v = sum(counts[1].values()), len(counts[1])
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    whole = 0.0
    for i, words in tokens.items():
        exact = 0.0
        for g in grams(words, 3):
            p = (counts[1][g[2:]] + 0.1) / (total + 0.1 * (v + 1))
            for n, prior in ((2, lm.PRIORS[0]), (3, lm.PRIORS[1])):
                before = g[3 - n : 2]
                context = len(train) if before[-1] is None else counts[n - 1][before]
                p = (counts[n][g[3 - n :]] + prior * p) / (context + prior)
            exact += math.log10(p)
        whole += exact
        assert got[i] == pytest.approx(exact, rel=0.02, abs=0.06 * len(words) + 0.1)  # levels are counts to within a tenth
    assert sum(got.values()) == pytest.approx(whole, rel=0.02)
    assert all(s <= 0 for s in got.values())


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << lm.KEY_BITS, 5000, dtype=np.uint64))
    levels = rng.integers(1, 12, len(keys))
    f = lm.LogFrequencyFilter(keys, levels)
    read = f.levels(keys)
    assert (read >= levels).all() and (read > levels).mean() < 0.05
    others = np.setdiff1d(rng.integers(0, 1 << lm.KEY_BITS, 5000, dtype=np.uint64), keys)
    assert (f.levels(others) > 0).mean() < 0.05


def test_levels():
    counts = np.array([0, 1, 2, 3, 4, 10, 1000])
    levels = lm.level_of(counts)
    assert (np.diff(levels) > 0).all() and levels[0] == 0 and levels[1] == 1
    assert np.allclose(lm.level_values()[levels], counts, rtol=0.15, atol=0)


def test_the_number_of_segments_changes_little_but_false_hits(spark):
    rows = odd_documents() + [(k, f"word w{k % 3} w{k} x{k}", *[None] * 8) for k in range(20, 400)]
    one, many = (lm.score_documents(frame(spark, rows), segment_grams=n).collect() for n in (1 << 30, 20))
    exact = lambda rows: sorted(((*r[:5], round(r[5], 8)) for r in rows), key=str)
    assert exact(one) == exact(many)
    assert sum(r[6] for r in one) == pytest.approx(sum(r[6] for r in many), rel=0.05)


def test_the_broadcast_and_the_joined_filter_are_the_same_bits(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lambda **settings: sorted(map(tuple, lm.score_documents(docs, segment_grams=1000, **settings).collect()))
    sent = rows()
    assert sent == rows(broadcast_bytes=-1)
    monkeypatch.setattr(lm, "ASKED_BYTES", 4000)  # segments are copied
    monkeypatch.setattr(lm, "HELD_GRAMS", 500)  # and counts come in many rows
    assert sent == rows(broadcast_bytes=-1, met_rows=1)


def test_scores_come_from_the_bits(spark, monkeypatch):
    """A filter without bits knows no n-gram: counts reach no score around it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    scores = lambda: sum(r["score"] for r in lm.score_documents(docs).collect())
    build, own = lm.Trained.of, scores()

    def emptied(rows, segment_bits):
        out = build(rows, segment_bits)
        out.filter.bits = np.zeros_like(out.filter.bits)
        return out

    monkeypatch.setattr(lm.Trained, "of", emptied)
    assert scores() < 1.5 * own < 0


def test_a_text_that_occurs_twice_scores_higher(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 900, 60))
    ids = [i for i in range(400) if not held(i)][:200]
    texts = [text() for _ in ids]
    texts[-20:] = texts[:20]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(frame(spark, [(i, t, *[None] * 8) for i, t in zip(ids, texts)])).collect()}
    twice, once = [got[i] for i in ids[:20]], [got[i] for i in ids[20:-20]]
    assert min(twice) > max(once)


PEAK = """
import re, sys, tempfile
from pathlib import Path
import pyspark
from pyspark.sql import SparkSession
from quern.llm import lm

folder = sys.argv[1]
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.local.dir", folder).config(
    "spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.shuffle.partitions", "4").getOrCreate()
words = "array_join(transform(sequence(1, 400), i -> concat('w', pmod(xxhash64(id, i), 300000))), ' ')"
spark.range(0, 12000, 1, 1).selectExpr("id AS doc_id", f"{words} AS text").write.parquet(f"{folder}/documents")
lm.score_documents(spark.read.parquet(f"{folder}/documents"), broadcast_bytes=-1).write.parquet(f"{folder}/out")
peaks = [0]
for p in Path("/proc").iterdir():
    try:
        own = p.name.isdigit() and b"pyspark.daemon" in (p / "cmdline").read_bytes() and folder.encode() in (p / "environ").read_bytes()
        peaks.append(int(re.search(r"VmHWM:\\s+(\\d+)", (p / "status").read_text())[1]) // 1024 if own else 0)
    except OSError:
        pass
print("peak", max(peaks), "MB of", spark.read.parquet(f"{folder}/out").count())
"""


def test_a_worker_holds_few_n_grams(tmp_path):
    """34 MB of text in one task, nearly all of whose n-grams differ, which is the most to hold."""
    env = {**os.environ, "PYTHONPATH": str(Path(lm.__file__).parents[2]), "QUERN_TEST_FOLDER": str(tmp_path)}
    said = subprocess.run([sys.executable, "-c", PEAK, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300).stdout
    peak, rows = int(said.split("peak ")[1].split()[0]), int(said.split()[-1])
    assert rows == 12000 and 0 < peak < 450


def test_counts_beyond_16_bits_stand_in_several_entries():
    own = lm.Counted(np.array([3, 5, 1 << 47], np.uint64), np.array([1, 200_000, 65_535]))
    packed = own.packed()
    assert len(packed) == 6
    back = lm.Counted.unpacked(np.r_[packed, packed])
    assert back.keys.tolist() == own.keys.tolist() and back.counts.tolist() == [2, 400_000, 131_070]


def test_numbers_of_keys_that_share_their_first_bits():
    keys = np.array([7, 4, 4, 6, (1 << 64) - 1, (1 << 64) - 2, 5, 7], np.uint64)
    distinct, places = lm._numbered(keys, 64)
    assert distinct.tolist() == sorted(set(keys.tolist())) and (distinct[places] == keys).all()
