"""Phrases of two to four words that occur together more often than their parts do.

Words frequent enough to be part of a phrase get numbers (a dictionary entry for each language and word); a piece of text is broken
wherever another word stands. From each remaining position the numbers of up to four words are packed into one binary key
of 16 bytes, zeros after the end. Keys are counted where they arise, partitioned by range and sorted with a radix sort;
the runs of a sorted part that share two, three or four numbers are the counts of all phrases at once, as every
occurrence of a phrase is the start of just one key. Runs cut by the border of a part are added up afterwards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quern.functions.names import column
from quern.sources.scratch import Scratch

#: Words of a phrase at most; the bytes of a key follow from it (two numbers of 32 bits to a long).
LONGEST = 4
#: Tokens of a chunk, about (a piece without punctuation is never divided), and bytes of text that are tokenised at a time.
CHUNK_TOKENS, STEP = 1 << 19, 1 << 21
#: Chunks of a file: Parquet's reader takes up to 4096 rows of a file at a time, and one chunk has some megabytes.
FILE_CHUNKS = 8
#: Keys that are sorted in one task, about.
PART_KEYS = 1 << 20
#: Dictionary numbers are given in so many buckets; buckets in which a language's phrases are ranked first.
NUMBER_BUCKETS, RANK_BUCKETS = 256, 64
UNDETERMINED = "und"
# A byte that UTF-8 never has stands for what ends a piece; the ends of pieces are fixed by the contract.
_END = b"\xff"
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about STEP bytes that end where pieces end."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > STEP:
            end = text.rfind(_END, start, start + STEP) + 1 or text.find(_END, start + STEP) + 1 or len(text)
        yield text[start:end]
        start = end


class Chunk:
    """Tokens of one language, as places in a list of its distinct words; 0 ends a piece."""

    def __init__(self):
        self.places = defaultdict(count(1).__next__, {_END: 0})
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, part: bytes) -> None:
        words = (part + _END).replace(_END, b" \xff ").split()
        self.tokens.append(np.fromiter(map(self.places.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self) -> tuple:
        tokens = np.concatenate(self.tokens)
        counts = np.bincount(tokens, minlength=len(self.places))[1:]
        return int(counts.sum()), list(self.places)[1:], counts, tokens


def chunked(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(chunk, lang, n, words, counts, tokens): texts packed by language into chunks that number their words themselves."""
    schema = "chunk long, lang string, n long, words array<string>, counts array<int>, tokens array<int>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = count(TaskContext.get().partitionId() << 32)
        open_: dict[str, Chunk] = defaultdict(Chunk)

        def closed():
            rows = [(next(number), lang, *chunk.row()) for lang, chunk in open_.items()]
            open_.clear()
            lists = lambda i, kind: pa.array([r[i] for r in rows], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64()),
                 lists(3, pa.string()), lists(4, pa.int32()), lists(5, pa.int32())], ["chunk", "lang", "n", "words", "counts", "tokens"],
            )

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for part in _parts(text.as_py().encode().lower().translate(_TABLE)):
                    chunk = open_[lang.as_py()]
                    size -= chunk.size
                    chunk.add(part)
                    size += chunk.size
                    if size >= CHUNK_TOKENS:
                        yield from closed()
                        size = 0
        if open_:
            yield from closed()

    lang = F.coalesce(column(lang_col).cast("string"), F.lit(UNDETERMINED))
    return docs.select(lang.alias("lang"), column(text_col).alias("text")).filter("text <> ''").mapInArrow(run, schema)


def dictionary(words: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words that occur at least so often in their language; ids from 1, below 2^31.

    Ids are given bucket by bucket, interleaved, so that no task sees all words and they stay about as small as their number.
    """
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(NUMBER_BUCKETS))
    nth = F.row_number().over(W.partitionBy("bucket").orderBy("lang", "word")).cast("long")
    number = (nth - 1) * NUMBER_BUCKETS + F.col("bucket") + 1
    fits = F.when(number < 2**31, number).otherwise(F.raise_error(F.lit("too many frequent words for numbers of 32 bits")))
    return frequent.withColumn("bucket", bucket).select("lang", "word", "f", fits.alias("id"))


def radix_order(*digits: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit numbers, most significant column first: a radix sort by 16 bits from the last."""
    order = np.arange(len(digits[0]))
    for x in reversed(digits):
        for shift in range(0, 64, 16):
            digit = (x >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def run_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    changed = np.zeros(max(0, len(sorted_columns[0]) - 1), bool)
    for x in sorted_columns:
        changed |= x[1:] != x[:-1]
    return np.flatnonzero(np.r_[True, changed]) if len(sorted_columns[0]) else np.zeros(0, np.int64)


def packed_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (two longs each) of the positions from which at least two words go on, sorted, with their counts."""
    follow = [ids.astype(np.uint64)]
    for k in range(1, LONGEST):
        follow.append(np.where(follow[-1] > 0, np.r_[follow[0][k:], np.zeros(min(k, len(ids)), np.uint64)], 0).astype(np.uint64))
    go_on = (follow[0] > 0) & (follow[1] > 0)
    a, b, c, d = (x[go_on] for x in follow)
    hi, lo = a << np.uint64(32) | b, c << np.uint64(32) | d
    order = radix_order(hi, lo)
    hi, lo = hi[order], lo[order]
    starts = run_starts(hi, lo)
    return hi[starts], lo[starts], np.diff(np.r_[starts, len(hi)])


def keys(chunks: DataFrame, numbers: DataFrame) -> DataFrame:
    """(hi, lo, n): counted keys of each chunk. numbers: (of, place, id), a chunk's frequent words; other words break pieces."""

    def run(chunk, numbered):
        import pyarrow as pa

        tokens = chunk.column("tokens").combine_chunks().flatten().to_numpy()
        ids = np.zeros(int(tokens.max(initial=0)) + 1, np.uint32)
        ids[numbered.column("place").to_numpy()] = numbered.column("id").to_numpy()
        hi, lo, n = packed_keys(ids[tokens])
        return pa.table({"hi": hi.view(np.int64), "lo": lo.view(np.int64), "n": n})

    return chunks.select("chunk", "tokens").groupBy("chunk").cogroup(numbers.groupBy("of")).applyInArrow(run, "hi long, lo long, n long")


def phrase_runs(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of 2 to 4 words (as keys) and their counts in a part of the keys: those that reach ``least``, and those
    that may go on in the parts before and after."""
    order = radix_order(hi, lo)
    hi, lo, n = hi[order], lo[order], n[order]
    out = []
    for mask in (0, 0xFFFFFFFF00000000, 0xFFFFFFFFFFFFFFFF):
        part = lo & np.uint64(mask)
        starts = run_starts(hi, part)
        counts = np.add.reduceat(n, starts) if len(starts) else n
        own = {0: np.uint64(1), 0xFFFFFFFF00000000: part[starts], 0xFFFFFFFFFFFFFFFF: part[starts] & np.uint64(0xFFFFFFFF)}[mask]
        keep = counts >= least
        keep[:1] = keep[-1:] = True
        keep &= own > 0  # a shorter key has no phrase of this length
        out.append((hi[starts][keep], part[starts][keep], counts[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def counted_phrases(counted: DataFrame, parts: int, least: int) -> DataFrame:
    """(hi, lo, a) of the phrases with a >= least. counted: keys, in any number of rows each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if got:
            hi, lo, n = (np.concatenate(x) for x in zip(*got))
            hi, lo, a = phrase_runs(hi.view(np.uint64), lo.view(np.uint64), n, least)
            yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(a)], ["hi", "lo", "a"])

    runs = counted.repartitionByRange(parts, "hi", "lo").mapInArrow(run, "hi long, lo long, a long")
    return runs.groupBy("hi", "lo").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _numbers() -> Column:
    """The numbers of a key's words, in an array of 2 to 4."""
    each = [F.shiftrightunsigned("hi", 32), F.col("hi").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("lo", 32), F.col("lo").bitwiseAND(0xFFFFFFFF)]
    return F.filter(F.array(*each), lambda x: x > 0)


def _key(numbers: Column) -> Column:
    """(hi, lo) of an array of 1 to 4 numbers."""
    at = lambda i: F.coalesce(F.get(numbers, F.lit(i)), F.lit(0).cast("long"))
    return F.struct((F.shiftleft(at(0), 32) + at(1)).alias("hi"), (F.shiftleft(at(2), 32) + at(3)).alias("lo"))


def scored(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """candidates (hi, lo, a) with l, r and score of their lowest cut, those with words inside a longer one that is
    nearly as frequent dropped. words: (id, f)."""
    listed = candidates.withColumn("w", _numbers())
    counts = candidates.unionByName(words.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), F.col("f").alias("a")))
    counts = counts.select(F.struct("hi", "lo").alias("part"), F.col("a").alias("f"))
    cut = listed.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    sides = F.array(_key(F.slice("w", F.lit(1), F.col("k"))), _key(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))))
    cut = cut.select("hi", "lo", "a", "k", F.posexplode(sides).alias("side", "part")).join(counts, "part")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cut = cut.groupBy("hi", "lo", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    # 2000000 * a may pass 64 bits
    cut = cut.withColumn("score", F.expr("(2000000 * cast(a as decimal(20, 0))) div (l + r)"))
    best = cut.groupBy("hi", "lo", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: _key(F.slice("w", i, m)))))
    inside = listed.filter(F.size("w") > 2).select("a", F.explode(inner).alias("p")).groupBy("p.hi", "p.lo").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["hi", "lo"], "left").filter("longer is null or 100 * longer < 80 * a")
    return kept.select("hi", "lo", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score (numbers long).

    By score descending, a descending, phrase ascending in byte order. Null texts count as empty, a null lang is ``und``;
    rows that repeat count each; a language without a phrase has no row, nor has an empty table. Texts are read whole: a long one
    is taken in parts that end where its pieces end, so only one endless piece takes some twenty times its size.
    One language, word, phrase or passage may hold any share of the rows: chunks send each word and key once, keys are
    dealt by ranges of whole keys, and ranks are cut in buckets first. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    chunks = scratch.table(chunked(docs, text_col, lang_col), FILE_CHUNKS)
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x"))
    words = words.select("chunk", "lang", (F.col("place") + 1).alias("place"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    known = scratch.table(dictionary(words, least))
    numbers = words.join(known, ["lang", "word"]).select(F.col("chunk").alias("of"), "place", "id")
    totals = scratch.table(chunks.groupBy("lang").agg(F.sum("n").alias("n")))
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffled, (totals.agg(F.sum("n")).first()[0] or 0) // PART_KEYS + 1)
    # ranges are found by packing the keys once more, which takes less than a written table of them
    candidates = scratch.table(counted_phrases(keys(chunks, numbers), parts, least))
    scratch.drop(chunks)
    found = scored(candidates, known.select("id", "f"))
    found = found.withColumn("w", _numbers()).select("*", F.posexplode("w").alias("at", "id")).join(known.select("id", "lang", "word"), "id")
    spelt = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]))
    found = found.groupBy("hi", "lo", "a", "l", "r", "score").agg(F.max("lang").alias("lang"), spelt.alias("phrase"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = found.withColumn("bucket", F.pmod(F.xxhash64("hi", "lo"), F.lit(RANK_BUCKETS)))
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*best))).filter(F.col("rank") <= most)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= most)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
