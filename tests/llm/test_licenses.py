import random
import re
from collections import Counter

from quern.llm.licenses import BASE_PHRASES, SHARE, SLACK, SPDX_TAG, TEMPLATES, Index, scan_licenses, words_of
from tests.llm.cases import ascii_lower, frame, odd_documents


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    places = []
    for phrase, label in BASE_PHRASES:
        part = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(part)] == part]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_against_brute_force(spark):
    extra = [(100, "MIT license mit LICENSE; mit\nlicense cc by by cc by", *[None] * 8), (101, "the mit  (license) apacheé license apache license", *[None] * 8)]
    rows = odd_documents() + extra
    got = scan_licenses(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert scan_licenses(frame(spark, [])).collect() == []


def test_every_template_is_found_amid_other_words_and_small_edits():
    index = Index.build(TEMPLATES, {})
    for t in TEMPLATES:
        if t.base or t == SPDX_TAG:
            continue
        words = words_of(t.text.encode())
        _, labels = index.scan([b"lorem"] * 50 + words + [b"ipsum"] * 50)
        assert labels.get(t.label) == float(t.key_phrases != (t.text,))
        alone = Index.build((t,), {})
        assert alone.scan(words)[1].keys() == {t.label}
        for phrase in t.key_phrases:  # each is mandatory
            assert alone.scan([w for w in words if w not in words_of(phrase.encode())]) == ([], {})
    mit = words_of(next(t.text for t in TEMPLATES if t.label == "mit" and len(t.text) > 100).encode())
    _, labels = index.scan(mit[:9] + [b"inserted"] + mit[9:])
    assert 0.9 < labels["mit"] <= 1


def test_scattered_words_are_no_notice():
    index = Index.build(TEMPLATES, {})
    words = sorted({w for t in TEMPLATES for w in words_of(t.text.encode()) if b" " in t.text.encode()})
    places, labels = index.scan(words[::-1])
    assert not labels and not [p for p in places if p[1] != "cc-by"]


def labels_of(text):
    return set(Index.build(TEMPLATES, {}).scan(words_of(text.encode()))[1])


def test_identifiers_and_combined_terms():
    assert labels_of("// SPDX-License-Identifier: MIT\nint main;") == {"mit"}
    assert labels_of("SPDX-License-Identifier: GPL-3.0-or-later") == {"gpl-3.0"}
    assert labels_of("Texts are under CC BY-NC-SA 4.0, images CC BY-ND.") == {"cc-by-nc-sa", "cc-by-nd"}
    assert labels_of("by nc sa cc") == set()
    assert labels_of("SPDX-License-Identifier: Apache-2.0 OR MIT") == {"apache-2.0", "mit"}
    assert labels_of("SPDX-License-Identifier: (MIT-0 AND GPL-2.0-only WITH Classpath-exception-2.0) file") == {"mit-0", "gpl-2.0", "classpath-exception-2.0"}
    assert labels_of("SPDX-License-Identifier: GPL-2.0-or-later OR BSD-3-Clause") == {"gpl-2.0", "bsd-3-clause"}
    assert labels_of("Creative Commons Attribution-NonCommercial-ShareAlike 3.0") == {"cc-by-nc-sa"}
    assert labels_of("Creative Commons Attribution-NoDerivatives") == {"cc-by-nd"}
    assert labels_of("Mozilla Public License Version 1.1") == {"mpl-1.1"} and labels_of("the Mozilla Public License.") == {"mpl"}
    assert labels_of("BSD 3-Clause License") == {"bsd-3-clause"} and labels_of("CDDL 1.0") == {"cddl-1.0"}


def test_words_elsewhere_take_no_label():
    alone = "BSD license applies here"
    assert labels_of(alone) == {"bsd"}
    vocabulary = sorted({w for t in TEMPLATES for w in words_of(t.text.encode())})
    r = random.Random(5)
    for _ in range(300):
        t = r.choice([t for t in TEMPLATES if not t.base and t != SPDX_TAG])
        idf = {w: r.random() for w in vocabulary}
        index, own = Index.build(TEMPLATES, idf), words_of(t.text.encode())
        before = index.scan(own)[1].keys()
        noise = [r.choice(vocabulary) for _ in range(r.randrange(40))]
        assert before <= index.scan([*noise, b"qqq", b"qqq", b"qqq", *own, b"qqq", b"qqq", b"qqq", *noise])[1].keys()


def test_rare_words_at_disagreeing_places_call_for_nothing():
    """The intersection decides: a template's anchors are all there, though not at one place."""
    index = Index.build(TEMPLATES, {})
    words = words_of(b"mozilla x public x license x version x 2 x 0")
    assert index.scan(words) == ([], {})
    k = next(k for k, t in enumerate(TEMPLATES) if t.text == "mozilla public license version 2 0")
    at = {w: [i for i, x in enumerate(words) if x == w] for w, _ in index.anchors[k]}
    assert len(at) == 3 and all(at.values()) and not index._agreed(k, at)


def slow_labels(words):
    """The rule without an index: every template at every place, its key phrases in place and its share of words near."""
    found = []
    for t in TEMPLATES:
        own = words_of(t.text.encode())
        parts = [words_of(p.encode()) for p in t.key_phrases]
        if t.base or t == SPDX_TAG or not {w for p in parts for w in p} <= set(words):
            continue
        slack = SLACK if len(parts) > 1 else 0
        for start in range(-len(own), len(words)):
            spans = []
            for part in parts:
                at = next(i for i in range(len(own)) if own[i : i + len(part)] == part)
                near = [a for a in sorted(range(start + at - slack, start + at + slack + 1), key=lambda a: abs(a - start - at)) if a >= 0 and words[a : a + len(part)] == part]
                spans += [(near[0], near[0] + len(part))] if near else []
            window = Counter(words[max(0, start - SLACK) : max(0, start + len(own) + SLACK)])
            if len(spans) == len(parts) and sum((Counter(own) & window).values()) >= SHARE * len(own):
                found.append((t.label, spans))
    every = {x for _, spans in found for x in spans}
    inside = {x for x in every if any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in every)}
    return {label for label, spans in found if not inside.issuperset(spans)}


def test_labels_against_a_scan_of_every_place():
    r = random.Random(3)
    pool = [words_of(t.text.encode()) for t in TEMPLATES]
    vocabulary = sorted({w for x in pool for w in x})
    idf = {w: r.random() for w in vocabulary}
    index = Index.build(TEMPLATES, idf)
    hits = 0
    for _ in range(150):
        words = []
        for _ in range(r.randrange(4)):
            part = list(r.choice(pool))
            for _ in range(r.randrange(4)):
                at = r.randrange(len(part))
                part[at : at + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
                part = part or [b"x"]
            words += r.choices(vocabulary, k=r.randrange(9)) + part
        got = set(index.scan(words)[1])
        assert got == slow_labels(words)
        hits += bool(got)
    assert hits > 50


def test_a_very_long_text(spark):
    text = "plain words here " * 100_000 + "released under the MIT license"
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["labels"]) == (300_005, 1, 300_003, "mit")
