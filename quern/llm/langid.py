"""Language identification by error-correcting output codes.

Each language has a codeword. For each of its bits a binary classifier, a naive Bayes log-odds over hashed byte
trigrams, tells the languages with that bit from those without. A text's mean log-odds are compared with every
codeword by a loss weighted with how far each bit separates the languages it was learned from; the codeword with
the smallest loss names the language, and a small lead over the next one marks the text as ambiguous.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.hashing import column_bytes, slices

FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
UNDETERMINED = "und"
#: Languages whose counts a worker holds at a time (0.5 MB each) before it passes them on.
HELD_LANGUAGES = 64
#: A lead of less than this share of the largest possible loss difference marks a text as ambiguous.
AMBIGUOUS_BELOW = 0.1

#: ASCII characters other than letters separate words.
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _letters(raw: bytes) -> bytes:
    """The lower-cased text with one space before, between and after its words; b"" if it has no letter."""
    text = raw.decode("utf-8")
    if not any(map(str.isalpha, text)):
        return b""
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS_ONLY).split()) + b" "


def _trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        return ((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1/-1, all different and none of the columns constant.

    Up to five languages get the exhaustive code, in which every split of the languages is one bit; more get
    random codewords of 12 bits for each doubling, drawn from a fixed seed until no two agree in over 3/4.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([np.where((splits >> (n - 1 - i)) & 1, 1, -1) if i else -np.ones(len(splits)) for i in range(n)], np.int8)
    bits, rng = int(12 * np.ceil(np.log2(n))), np.random.default_rng(seed)
    while True:
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        same = (code.astype(int) @ code.T + bits) / 2 - np.eye(n) * bits
        if same.max() <= 0.75 * bits and (np.abs(code.sum(0, dtype=int)) < n).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits, log-odds divided by the bit's mean separation
    trust: np.ndarray  # of each bit, summing to 1

    @classmethod
    def from_counts(cls, counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        code = codewords(len(languages))
        if len(languages) < 2:
            return cls(languages, code, np.zeros((FEATURES, 1), np.float32), np.ones(1))
        table = np.array([counts[x] for x in languages], np.float64)
        share = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * FEATURES)
        on = (code > 0).astype(float)
        plus = (share.T @ on) / on.sum(0)
        minus = (share.T @ (1 - on)) / (1 - on).sum(0)
        odds = np.log(plus / minus)
        apart = (code * (share @ odds)).mean(0)
        # a bit that tells nothing apart (languages with the same counts) has no say
        useful = apart > 1e-9
        if not useful.any():
            return cls(languages, code, np.zeros(odds.shape, np.float32), np.full(len(apart), 1 / len(apart)))
        odds = np.where(useful, odds / np.where(useful, apart, 1.0), 0.0)
        return cls(languages, code, odds.astype(np.float32), np.where(useful, apart, 0.0) / apart[useful].sum())

    def predict(self, data: bytes, offsets: list[int]) -> Iterator[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text of a buffer."""
        for a, b in slices(offsets, 1 << 19):
            texts = [_letters(data[s:e]) for s, e in zip(offsets[a:b], offsets[a + 1 : b + 1])]
            filled = [i for i, t in enumerate(texts) if t]
            out = [(UNDETERMINED, 0.0, True)] * len(texts)
            if filled and self.languages:
                sizes = np.array([len(texts[i]) for i in filled])
                at = np.cumsum(sizes) - sizes
                rows = self.weights[_trigrams(b"".join(texts[i] for i in filled) + b"  ")]
                sums = np.add.reduceat(rows, np.ravel(np.column_stack([at, at + sizes - 2])), axis=0, dtype=np.float64)[::2]
                out_of = self._decode(sums / (sizes - 2)[:, None])
                for k, i in enumerate(filled):
                    out[i] = out_of[k]
            yield from out

    def _decode(self, margins: np.ndarray) -> list[tuple[str, float, bool]]:
        agree = margins[:, None, :] * self.code[None]  # texts x languages x bits
        loss = (np.logaddexp(0.0, -4.0 * np.clip(agree, -4, 4)) * self.trust).sum(2)
        best = loss.argmin(1)
        odds = np.exp(-4.0 * (loss - loss.min(1, keepdims=True)))
        score = 1 / odds.sum(1)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        vague = second - loss.min(1) < AMBIGUOUS_BELOW * 4.0
        return [(self.languages[i], float(s), bool(v)) for i, s, v in zip(best, score, vague)]


def _counts(texts: DataFrame) -> DataFrame:
    """(lang, feature, n) over all rows of (lang, text); each worker passes on sums, so a frequent language stays spread."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(FEATURES, np.int64))

        def passed_on() -> Iterator:
            for lang, counts in held.items():
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(counts[hit])], ["lang", "feature", "n"]
                )
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = column_bytes(batch.column(1))
            by_lang = defaultdict(list)
            for lang, s, e in zip(langs, offsets, offsets[1:]):
                by_lang[lang].append((s, e))
            for lang, spans in by_lang.items():
                sizes = np.cumsum([0] + [e - s for s, e in spans]).tolist()
                for a, b in slices(sizes, 1 << 19):
                    # the three bytes over the border of two texts are of no text: count each text's end apart
                    texts = [t for t in (_letters(data[s:e]) for s, e in spans[a:b]) if t]
                    if texts:
                        joined, lengths = b"".join(texts) + b"  ", np.array([len(t) for t in texts])
                        grams = np.delete(_trigrams(joined), np.ravel(np.cumsum(lengths)[:, None] - [2, 1]))
                        held[lang] += np.bincount(grams, minlength=FEATURES)
                if len(held) > HELD_LANGUAGES:
                    yield from passed_on()
        yield from passed_on()

    return texts.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from every row of docs with a text and a language; their number is not limited.

    The driver gets at most FEATURES sums for each language.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    table = _counts(rows).toArrow()
    langs = table.column("lang").dictionary_encode().combine_chunks()
    counts = np.zeros((len(langs.dictionary), FEATURES), np.int64)
    counts[langs.indices.to_numpy(), table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return Model.from_counts(dict(zip(langs.dictionary.to_pylist(), counts)))


def with_language(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred (a learned language or "und"), score (0 to 1) and ambiguous, read from the whole text alone.

    Null texts and texts without a letter get "und", score 0 and are ambiguous; so do all if nothing was learned.
    A text that fits several languages alike (two with the same counts) is ambiguous and gets the first of them. A very
    long text takes about ten times its size in a worker. Repeated rows give repeated results, an empty table none;
    docs must not have the new columns' names (``prefix`` goes before them).
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model)
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}ambiguous"]
    # the worker sees columns by number, as their names may hold dots and backticks
    numbers = [f"c{k}" for k in range(len(docs.columns) + 3)]
    kinds = [*(f.dataType for f in docs.schema.fields), T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([T.StructField(*x) for x in zip(numbers, kinds)])
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = list(known.value.predict(*column_bytes(batch.column(place))))
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(batch.columns + more, numbers)

    return docs.toDF(*numbers[:-3]).mapInArrow(run, schema).toDF(*docs.columns, *names)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id has fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, ambiguous), one row per row of docs.

    Learns from the folds 0 and 2 of three; ids only choose the fold. See ``with_language`` for nulls and empty
    and very long texts. Rows without a language teach nothing. Repeated rows count and are answered as often as they
    stand. Other columns are not read. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(slim.filter(fold("id", 3) != 1))
    asked = slim.select("id", (fold("id", 3) == 1).alias("held_out"), "text")
    return with_language(asked, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "ambiguous")
