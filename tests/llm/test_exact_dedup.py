import hashlib
from collections import Counter, defaultdict

import pytest

from quern.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tests.llm.cases import ascii_lower, frame, odd_documents


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[ascii_lower(r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block,bits", [(4096, 64), (8, 64), (16, 3)])
def test_against_brute_force(spark, block, bits):
    """Small blocks make many levels; three hash bits make different blocks share a hash."""
    got = exact_duplicates(frame(spark), block_bytes=block, hash_bits=bits).collect()
    assert Counter(map(tuple, got)) == brute(odd_documents())


def test_empty_table(spark):
    assert exact_duplicates(frame(spark, [])).collect() == []


def test_drop_keeps_one_row_of_each_text(spark):
    docs = frame(spark)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = Counter(ascii_lower(r["text"] or "") for r in kept.collect())
    assert texts == Counter({ascii_lower(r[1] or "") for r in odd_documents()})


def test_plan_has_no_python(spark):
    plan = exact_duplicates(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
