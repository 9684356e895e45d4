"""English stems by the published Porter2 rules, for token arrays, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import MARKED, PLAIN_

# The word and suffix lists of the published algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_STARTS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWELS = "aeiouy"


def _after(word: str, start: int) -> int:
    """Position after the first non-vowel that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _voweled(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay as they are."""
    if len(word) < 3 or word in WHOLE:
        return WHOLE.get(word, word)
    word = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS) else c for i, c in enumerate(word))
    r1 = next((len(p) for p in REGION_STARTS if word.startswith(p)), None)
    r1 = _after(word, 0) if r1 is None else r1
    r2 = _after(word, r1)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _voweled(word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word

    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _voweled(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = _longest(word, STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            word = before + STEP2[end]
    end = _longest(word, STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]
    end = _longest(word, STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda xs: None if xs is None else [stem(x) for x in xs])


def stems(tokens: Column) -> Column:
    """Stems of an array of tokens; null stays null."""
    return F.pandas_udf(_stems, T.ArrayType(T.StringType()))(tokens)


#: Tokens that are counted at a time, about.
TOKENS = 1 << 22
_FOLDED = str.maketrans(MARKED, PLAIN_)


def term_counts(batches: Iterator, words: str) -> Iterator:
    """(batch, terms, row, term, tf) of Arrow batches with a list of words in each row: terms are the distinct stems, and row r holds
    terms[t] so often for each place of row, term and tf. A row's words are counted where they stand, each distinct word
    is folded and stemmed once a batch. Batches are cut into slices of about TOKENS words."""
    for whole in batches:
        ends = whole.column(words).offsets.to_numpy()[1:].astype(np.int64)
        start = 0
        while start < len(ends):
            first = ends[start - 1] if start else ends[0] - len(whole.column(words)[0])
            stop = max(start + 1, int(np.searchsorted(ends, first + TOKENS, "right")))
            batch, start = whole.slice(start, stop - start), stop
            lists = batch.column(words)
            known = lists.flatten().dictionary_encode()
            numbers: dict[str, int] = {}
            of_word = [numbers.setdefault(stem(w.translate(_FOLDED)), len(numbers)) for w in known.dictionary.to_pylist()]
            term = np.array(of_word, np.int64)[known.indices.to_numpy()]
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            pairs, tf = np.unique(row * max(1, len(numbers)) + term, return_counts=True)
            row, term = np.divmod(pairs, max(1, len(numbers)))
            yield batch, list(numbers), row, term, tf
