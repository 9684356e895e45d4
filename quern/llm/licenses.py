"""License scans with a positional rare-token index.

Templates (licence notices and names) are indexed by the words of their mandatory key phrases: word -> (template, position).
A file's licence words are taken by IDF: the rarest word of a template calls for it, and the file's places of its rarest
mandatory words, less their positions in the template, are intersected. A place that all agree on is verified: the key
phrases must stand where the template has them, and SHARE of its words near. What else a file holds changes none of this, so
no label is lost to words elsewhere. Rarity is measured over the corpus: a word's IDF comes from the number of
documents that hold it. After an SPDX tag the expression is read, operand by operand.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.hashing import column_bytes


@dataclass(frozen=True)
class Template:
    """A notice to look for: its words, and phrases that must stand where the notice has them."""

    label: str
    text: str
    key_phrases: tuple[str, ...]
    #: phrases count all their places as base places; notices give labels
    base: bool = False


# The phrases and labels that every scan reports.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Wordings of public licence notices, and the phrases without which they are something else.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("neither the name", "endorse or promote products")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by", "free software foundation")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form is subject to", "mozilla public license v 2 0")),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0 universal", ("dedicated the work to the public domain",)),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("provided by the copyright holders and contributors as is", "are disclaimed")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included in all copies",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("provided as is without any express or implied warranty", "authors be held liable")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
)

# Names of licences as notices give them, and what follows them for a version.
NAMES = (
    ("mit", "mit license"), ("isc", "isc license"), ("unlicense", "the unlicense"), ("0bsd", "zero clause bsd license"),
    ("bsd", "bsd license"), ("bsd-2-clause", "bsd 2 clause license"), ("bsd-2-clause", "2 clause bsd license"), ("bsd-2-clause", "simplified bsd license"),
    ("bsd-3-clause", "bsd 3 clause license"), ("bsd-3-clause", "3 clause bsd license"), ("bsd-3-clause", "new bsd license"),
    ("apache-2.0", "apache license version 2 0"), ("apache-2.0", "apache license 2 0"), ("apache-2.0", "apache license v2 0"), ("apache-1.1", "apache license version 1 1"),
    ("gpl-2.0", "gnu general public license version 2"), ("gpl-2.0", "gnu general public license v2"), ("gpl-2.0", "gplv2"),
    ("gpl-3.0", "gnu general public license version 3"), ("gpl-3.0", "gnu general public license v3"), ("gpl-3.0", "gplv3"),
    ("lgpl", "gnu lesser general public license"), ("lgpl-2.1", "gnu lesser general public license version 2 1"), ("lgpl-3.0", "gnu lesser general public license version 3"),
    ("agpl", "gnu affero general public license"), ("agpl-3.0", "gnu affero general public license version 3"),
    ("mpl", "mozilla public license"), ("mpl-1.1", "mozilla public license version 1 1"), ("mpl-2.0", "mozilla public license version 2 0"), ("mpl-2.0", "mozilla public license v 2 0"), ("mpl-2.0", "mozilla public license 2 0"),
    ("epl", "eclipse public license"), ("epl-1.0", "eclipse public license v1 0"), ("epl-2.0", "eclipse public license 2 0"), ("epl-2.0", "eclipse public license v 2 0"),
    ("cddl", "common development and distribution license"), ("cddl-1.0", "common development and distribution license version 1 0"), ("cddl-1.0", "cddl 1 0"),
    ("bsl-1.0", "boost software license version 1 0"), ("zlib", "zlib license"), ("wtfpl", "do what the fuck you want to public license"),
    ("ofl-1.1", "sil open font license version 1 1"), ("artistic-2.0", "artistic license 2 0"), ("cc0", "creative commons zero"), ("cc0", "cc0 1 0 universal"),
)

# Identifiers of the SPDX list and exceptions, as they stand after "SPDX-License-Identifier:".
SPDX = "MIT MIT-0 Apache-1.1 Apache-2.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause MPL-1.1 MPL-2.0 ISC EPL-1.0 EPL-2.0 BSL-1.0 CDDL-1.0 CDDL-1.1 Zlib 0BSD CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 Unlicense WTFPL OFL-1.1 Artistic-2.0 Classpath-exception-2.0 LLVM-exception GCC-exception-3.1 Linux-syscall-note".split()

# Terms of Creative Commons in short, and the spellings of their names.
CC_TERMS = ("by nc", "by sa", "by nd", "by nc sa", "by nc nd")
CC_SPELLINGS = {
    "by": ("attribution",), "nc": ("noncommercial", "non commercial"), "sa": ("sharealike", "share alike"),
    "nd": ("noderivatives", "noderivs", "no derivatives", "no derivs"),
}


def _phrase(label: str, words: str, base: bool = False) -> Template:
    return Template(label, words, (words,), base)


def _cc_names() -> list[Template]:
    terms = [x.split() for x in ("by", *CC_TERMS)]
    return [_phrase("cc-" + "-".join(t), "creative commons " + " ".join(names)) for t in terms for names in product(*(CC_SPELLINGS[x] for x in t))]


#: Stands for the expression that follows it.
SPDX_TAG = _phrase("", "spdx license identifier")
TEMPLATES = (
    *(_phrase(label, phrase, True) for phrase, label in BASE_PHRASES), *NOTICES, *(_phrase(*x) for x in NAMES), *_cc_names(),
    *(_phrase("cc-" + x.replace(" ", "-"), f"cc {x}") for x in CC_TERMS), SPDX_TAG,
)

#: A template's rarest mandatory words, whose places in a file are intersected.
ANCHORS = 3
#: Share of a template's words that must stand near its place, and by how many words a phrase may be off its own.
SHARE, SLACK = 0.6, 2

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and any characters beyond ASCII."""
    return raw.translate(_WORD_BYTES).split()


_IDS = {tuple(words_of(x.encode())): x.lower() for x in SPDX}
_LONGEST_ID = max(map(len, _IDS))


def spdx_labels(words: list[bytes], at: int) -> list[tuple[tuple[int, int], str]]:
    """(span, label) of the identifiers of the expression at a word: operands joined by and, or, with; later versions count as theirs."""
    found = []
    while True:
        size = next((n for n in range(_LONGEST_ID, 0, -1) if tuple(words[at : at + n]) in _IDS and at + n <= len(words)), 0)
        if not size:
            return found
        found.append(((at, at + size), _IDS[tuple(words[at : at + size])]))
        at += size
        if words[at : at + 2] == [b"or", b"later"]:
            at += 2
        elif words[at : at + 1] == [b"only"]:
            at += 1
        if words[at : at + 1] not in ([b"or"], [b"and"], [b"with"]):
            return found
        at += 1


@dataclass
class Index:
    templates: tuple[Template, ...]
    words: list[list[bytes]]
    #: per template: (first word's position, words) of its key phrases, and all their words
    keys: list[list[tuple[int, list[bytes]]]]
    mandatory: list[frozenset[bytes]]
    #: per template: its rarest mandatory words by IDF, each with its positions in the key phrases
    anchors: list[list[tuple[bytes, list[int]]]]
    #: rarest mandatory word -> templates
    by_rarest: dict[bytes, list[int]]

    @classmethod
    def build(cls, templates: tuple[Template, ...], idf: dict[bytes, float]) -> Index:
        words = [words_of(t.text.encode()) for t in templates]
        keys, mandatory, anchors, by_rarest = [], [], [], defaultdict(list)
        for k, (t, own) in enumerate(zip(templates, words)):
            spans, places = [], defaultdict(list)
            for phrase in t.key_phrases:
                part = words_of(phrase.encode())
                at = next(i for i in range(len(own)) if own[i : i + len(part)] == part)
                spans.append((at, part))
                for i, w in enumerate(part, at):
                    places[w].append(i)
            rare = sorted(places, key=lambda w: (-idf.get(w, 0.0), w))
            keys.append(spans)
            mandatory.append(frozenset(places))
            anchors.append([(w, places[w]) for w in rare[: 1 if t.base else ANCHORS]])
            by_rarest[rare[0]].append(k)
        return cls(templates, words, keys, mandatory, anchors, dict(by_rarest))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base places as (start, label), and labels of verified notices and names with the share of their words found (names: 0)."""
        held = set(words)
        chosen = [k for w in held & self.by_rarest.keys() for k in self.by_rarest[w] if self.mandatory[k] <= held]
        if not chosen:
            return [], {}
        at: dict[bytes, list[int]] = {w: [] for k in chosen for w, _ in self.anchors[k]}
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        places, found = [], []
        for k in sorted(chosen):
            t, own = self.templates[k], self.words[k]
            if t.base:
                (w, positions), = self.anchors[k]
                starts = {i - p for i in at[w] for p in positions}
                places += [(s, t.label) for s in starts if s >= 0 and words[s : s + len(own)] == own]
                continue
            for start in sorted(self._agreed(k, at)):
                spans = [self._stands(words, start + p, part) for p, part in self.keys[k]]
                if None in spans:
                    continue
                if t.label == SPDX_TAG.label:
                    found += [([span], label, 0.0) for span, label in spdx_labels(words, spans[0][1])]
                    continue
                window = Counter(words[max(0, start - SLACK) : max(0, start + len(own) + SLACK)])
                share = sum((Counter(own) & window).values()) / len(own)
                if share >= SHARE:
                    found.append((spans, t.label, share if t.key_phrases != (t.text,) else 0.0))
        labels = {}
        for spans, label, share in self._outermost(found):
            labels[label] = max(labels.get(label, 0.0), share)
        return sorted(places), labels

    def _agreed(self, k: int, at: dict[bytes, list[int]]) -> set[int]:
        """Places of a template that all its anchors agree on; a name stands as it is, phrases of a notice may be off by SLACK."""
        slack = 0 if len(self.keys[k]) == 1 else SLACK
        agreed = None
        for w, positions in self.anchors[k]:
            own = {i - p + d for i in at[w] for p in positions for d in range(-slack, slack + 1)}
            agreed = own if agreed is None else agreed & own
        return agreed

    @staticmethod
    def _outermost(found: list) -> list:
        """Without those all of whose key phrases stand inside longer key phrases of others: cc by nc in cc by nc sa."""
        spans = sorted({x for own, *_ in found for x in own}, key=lambda x: (x[0], -x[1]))
        inside, last = set(), None
        for x in spans:
            if last and x[1] <= last[1]:
                inside.add(x)
            else:
                last = x
        return [x for x in found if not inside.issuperset(x[0])]

    @staticmethod
    def _stands(words: list[bytes], at: int, part: list[bytes]) -> tuple[int, int] | None:
        """Start and end of the part, at its place or near it."""
        near = sorted(range(at - SLACK, at + SLACK + 1), key=lambda a: abs(a - at))
        return next(((a, a + len(part)) for a in near if a >= 0 and words[a : a + len(part)] == part), None)


def word_idf(docs: DataFrame, text_col: str, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """IDF of every word of the templates over all documents; the driver gets one count per template word."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text.encode()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, n = Counter(), 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for s, e in zip(offsets, offsets[1:]):
                seen.update(vocabulary.intersection(words_of(data[s:e])))
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"word": [*(w.decode() for w in seen), None], "n": [*seen.values(), n]})

    rows = docs.select(F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in rows.collect()}
    total = counts.pop(None, 0)
    return {w: math.log((total + 1) / (counts.get(w.decode(), 0) + 1)) for w in vocabulary}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and largest word at
    which one starts (null if none). labels adds the labels of verified notices; notices holds those with the share
    of the notice's words that were found. score: 0 without a label, 0.5 for phrases, names and SPDX identifiers alone, otherwise 0.5
    plus half of the best share of a notice. Null and empty texts have no words and no labels ("" and score 0). Texts are read
    whole; a very long one takes about fifteen times its size in a worker. Repeated rows give repeated results; other
    columns are not read; an empty table gives no rows.
    """
    index = Index.build(templates, word_idf(docs, text_col, templates))
    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType())]
    fields += [("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
    fields += [("notices", T.MapType(T.StringType(), T.DoubleType()))]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(*f) for f in fields)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            columns: list[list] = [[] for _ in fields]
            for s, e in zip(offsets, offsets[1:]):
                words = words_of(data[s:e])
                places, notices = index.scan(words)
                base = {label for _, label in places}
                starts = [at for at, _ in places]
                score = 0.5 * bool(base or notices) + 0.5 * max(notices.values(), default=0.0)
                row = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | notices.keys())), score, list(notices.items()))
                for column, value in zip(columns, row):
                    column.append(value)
            arrays = [batch.column(0)] + [pa.array(c, f.type) for c, f in zip(columns, list(kinds)[1:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id_col)
