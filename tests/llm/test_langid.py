import math
import zlib

import numpy as np

from quern.llm.langid import Model, codewords, identify, train, with_language
from tests.llm.cases import frame, odd_documents


def test_codewords_differ_and_have_no_constant_bit():
    for n in (2, 3, 4, 5, 9, 40):
        code = codewords(n).astype(int)
        assert len({tuple(r) for r in code}) == n
        assert (np.abs(code.sum(0)) < n).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and {r["doc_id"] for r in held} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1} & {r["doc_id"] for r in got}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_predictions_use_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs)
    asked = frame(spark).select("doc_id", "text")
    alone = sorted(map(str, with_language(asked, model).collect()))
    shuffled = sorted(map(str, with_language(asked.repartition(7), model).collect()))
    assert alone == shuffled


def test_odd_documents(spark):
    got = identify(frame(spark)).collect()
    assert len(got) == len(odd_documents())
    for r in got:
        text = [t for i, t, *_ in odd_documents() if i == r["doc_id"] and i is not None]
        if text and not any(c.isalpha() for c in text[0] or ""):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
        assert 0 <= r["score"] <= 1
    assert identify(frame(spark, [])).collect() == []


def test_nothing_learned_and_one_language():
    assert list(Model.from_counts({}).predict(b"abc", [0, 3])) == [("und", 0.0, True)]
    one = Model.from_counts({"xx": np.ones(1 << 16, np.int64)})
    assert [r[0] for r in one.predict(b"abc", [0, 3, 3])] == ["xx", "und"]


def test_a_mixed_text_is_ambiguous(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {r["lang"]: r["text"][:400] for r in docs.filter("n_chars > 600 and n_chars < 1500").collect()}
    model = train(docs)
    texts = [by["en"], by["de"] , by["de"] + " " + by["fr"]]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)]).tolist()
    scores = list(model.predict(b"".join(raw), offsets))
    assert [s[0] for s in scores[:2]] == ["en", "de"] and scores[2][1] <= min(scores[0][1], scores[1][1])


def test_languages_that_are_the_same_are_ambiguous():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, 1 << 16), rng.integers(0, 5, 1 << 16)
    assert list(Model.from_counts({"x": a, "y": a}).predict(b"some text", [0, 9])) == [("x", 0.5, True)]
    three = list(Model.from_counts({"x": a, "y": b, "z": b}).predict(b"some text", [0, 9]))
    assert 0 <= three[0][1] <= 1 and (three[0][0] == "x" or three[0][2])


def slow_prediction(counts, text):
    """Naive Bayes bits and loss-weighted decoding, number by number."""
    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    slot = lambda g: ((g[0] | g[1] << 8 | g[2] << 16) * 2654435761 % 2**32) >> 16
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    share = {x: [(counts[x].get(f, 0) + 0.5) / (total[x] + 0.5 * 65536) for f in range(65536)] for x in langs}
    words = b" " + b" ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).encode().split()) + b" "
    losses = {x: 0.0 for x in langs}
    weights = 0.0
    code = codewords(len(langs)).tolist()
    for bit in range(len(code[0])):
        on, off = [x for x, row in zip(langs, code) if row[bit] > 0], [x for x, row in zip(langs, code) if row[bit] < 0]
        odds = [math.log(sum(share[x][f] for x in on) / len(on) / (sum(share[x][f] for x in off) / len(off))) for f in range(65536)]
        apart = sum(row[bit] * sum(p * o for p, o in zip(share[x], odds)) for x, row in zip(langs, code)) / len(langs)
        margin = sum(odds[slot(g)] for g in grams(words)) / len(grams(words)) / apart
        weights += apart
        for x, row in zip(langs, code):
            losses[x] += apart * math.log1p(math.exp(-4 * max(-4, min(4, margin * row[bit]))))
    losses = {x: v / weights for x, v in losses.items()}
    best = min(losses, key=losses.get)
    return best, 1 / sum(math.exp(4 * (losses[best] - v)) for v in losses.values())


def test_predictions_against_brute_force(spark):
    texts = [("a", "the cat and the dog sat"), ("a", "THE end, of it"), ("b", "der Hund und die Katze"), ("b", "ein Ende é"), ("c", "le chien et la fin"), (None, "taught nothing")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    counts = {}
    for x, t in texts:
        w = b" " + b" ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in t.lower()).encode().split()) + b" "
        for i in range(len(w) - 2):
            f = ((w[i] | w[i + 1] << 8 | w[i + 2] << 16) * 2654435761 % 2**32) >> 16
            if x:
                counts.setdefault(x, {}).setdefault(f, 0)
                counts[x][f] += 1
    model = train(docs)
    for text in ("the dog", "die Katze und der Hund", "le chien", "é", "unknown words", "long " * 100_000):
        raw = text.encode()
        (lang, score, _), *_ = model.predict(raw, [0, len(raw)])
        want = slow_prediction(counts, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4
