import itertools
import re
from collections import Counter

from quern.llm.interactions import audit_filters
from tests.llm.cases import SCHEMA, frame, odd_documents

LABELS = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (8, 1, 1), (10, None, 1), (None, 1, 1), (99, 1, 1)]


def mask_of(text, doc_id, earlier):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t))]
    return "".join(f for f, x in zip("ABCDE", [*fails, doc_id is not None and any(d < doc_id and x == t for d, x in earlier)]) if x)


def brute(rows, labels):
    """Runs every order over the documents, filter by filter."""
    seen = [(r[0], r[1] or "") for r in rows if r[0] is not None]
    docs = [(r[3] or "", mask_of(r[1], r[0], seen), r[0]) for r in rows]
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    out = {}
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                fails = [d for d in own if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                total[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(fails) - len(gone), sum(d[1] == letter for d in own), sum(d[2] in good for d in gone), sum(d[2] in toxic for d in gone), letter]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = total.get(row[-1], 0) if isinstance(row[-1], str) else row[-1]
    return {k: tuple(v) for k, v in out.items()}


def test_every_order_agrees_with_running_it(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = odd_documents() + [(k, t, None, s, None, "", "", "", "", "") for k, (t, s) in enumerate([(long, "s1"), (long, "s2"), (long + " #", "s1"), ("A" * 9 + long, ""), (long, "s1"), ("x y " * 300_000, "s9")], 100)]
    labels = spark.createDataFrame(LABELS + [(100, 1, 0), (104, 1, 1)], "doc_id long, quality int, toxic int")
    found = audit_filters(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == brute(rows, LABELS + [(100, 1, 0), (104, 1, 1)])
    assert len(found) == 600 * len({r[3] or "" for r in rows})


def test_no_documents(spark):
    assert audit_filters(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
