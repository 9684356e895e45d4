"""Language-model scoring with a log-frequency Bloom filter.

The filter holds n-gram counts quantised to levels on a log scale: an n-gram of level q is entered q times, as
(n-gram, 1) to (n-gram, q). To read a count, probe (n-gram, 1), (n-gram, 2), ... until one is missing. Probabilities
come from such counts, smoothed by mixing each order with the one below.

Texts are cut into tokens once and written as chunks: distinct words, and each token's place among them. Training: tasks add up
the n-grams of their chunks, the counts of an n-gram meet in its segment of the filter, and the segment's bits are written;
counts of longer n-grams end there. Scoring: a worker knows n-grams by probing bits alone. As long as all bits are at most
BROADCAST_BYTES, they are broadcast. A filter of all n-grams grows with the corpus, so a larger one stays where it is written,
and segments of bits are joined with the n-grams that chunks ask of them, each once a chunk; both ways probe the same bits
and give the same rows. Counts and questions go to their segments in rounds, each of its own segments.

Beside that model stands an exact unigram score, whose word counts lie beside the bits. Words are known by their 64-bit
XXH64, longer n-grams by 48 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import ClassVar

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.hashing import column_bytes, slices, xxh64_slices
from quern.llm.langid import fold
from quern.sources.scratch import Scratch

KEY_BITS = 48
#: n-grams of orders 1 to ORDER; levels grow by LOG_BASE.
ORDER, LOG_BASE = 3, 1.2
#: Weight of the order below in the orders from 2 on, in observations; the last holds for all further orders.
PRIORS = (100.0, 3.0)
#: An item takes ITEM_BITS of its segment and PROBES probes; a false hit, which can raise one token a thousandfold, is rare (0.06 %).
ITEM_BITS, PROBES = 16, 8
#: Added to every count of the exact unigram score.
ADDED = 0.1
#: Distinct n-grams of chunks that meet in one segment's task, about.
SEGMENT_GRAMS = 1 << 20
#: Text of a chunk, about: its n-grams are looked up once each.
CHUNK_BYTES = 1 << 23
#: Chunks of a file: Parquet's reader takes up to 4096 rows of a file at a time, and one chunk has some megabytes.
FILE_CHUNKS = 4
#: Longer n-grams, distinct in their chunks, that a task holds before it sends their counts to the segments.
HELD_GRAMS = 1 << 21
#: Largest counts of words and of longer n-grams in one entry; what is beyond stands in further entries.
MOST_WORDS, MOST_GRAMS = (1 << 32) - 1, (1 << 16) - 1
#: Rows of counts that meet in one group at most; beyond them, groups of so many are added up before.
MET_ROWS = 1 << 12
#: Bits and word counts that are broadcast at most; each worker holds them, and twice for a moment.
BROADCAST_BYTES = 1 << 25
#: Bytes of counts from which a segment is much asked; it is copied once for each so many, and asked in turn.
ASKED_BYTES = 1 << 26
#: Rounds in which chunks send counts, and then ask, each of its own segments: what is shuffled at once is as much smaller,
#: and freed after each.
ROUNDS = 4
#: Bytes of text to a token, about: only sizes follow from it.
TOKEN_BYTES = 6


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def tokens(texts: bytes, offsets: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, token hashes, first token of each text and the end) for parts of a buffer.

    A-Z are lower-cased; tokens are runs of bytes other than ASCII white space; every text ends with the empty
    word, which stands for its end.
    """
    for a, b in slices(offsets):
        joined = [b" ".join(texts[s:e].lower().split()) for s, e in zip(offsets[a:b], offsets[a + 1 : b + 1])]
        # one space closes each word, one more the empty word at the end
        data = b"".join(x + b"  " if x else b" " for x in joined)
        sizes = np.array([len(x) + 2 if x else 1 for x in joined])
        stops = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts = np.r_[0, stops[:-1] + 1]
        first = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
        yield a, b, xxh64_slices(data, starts, stops - starts), first


def _gram_key(x: np.ndarray) -> np.ndarray:
    return _mix(x) >> np.uint64(64 - KEY_BITS)


def ngram_keys(hashes: np.ndarray, first: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Keys of the n-grams that end at each token, for n = 2 to order; a text's first tokens follow a start mark."""
    keys = before = hashes
    opens = np.zeros(len(hashes), bool)
    opens[first[:-1]] = True
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            before = np.r_[np.uint64(0), before[:-1]]
            before[opens] = np.uint64(n)  # the start mark, whatever stands before in the buffer
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + before)
            yield _gram_key(keys)


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log(count)) in LOG_BASE; 0 for 0."""
    return np.searchsorted(level_starts(), count, "right").astype(np.int64)


def level_starts() -> np.ndarray:
    """Smallest count of each level from 1 on, beyond any count there is; a level fits in a byte."""
    return np.unique(np.ceil(LOG_BASE ** np.arange(0, 180) - 1e-9)).astype(np.float64)


def level_values() -> np.ndarray:
    """The count that a level stands for: the middle of its counts; 0 for level 0."""
    lows = level_starts()
    return np.r_[0.0, (lows[:-1] + lows[1:] - 1) / 2]


class LogFrequencyFilter:
    """Segments of bits, each sized by the items that go into it; made as one segment, or joined from several."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        size = max(64, -(-int(levels.sum()) * ITEM_BITS // 8) * 8)
        bits = np.zeros(size, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= level], levels[levels >= level]
            place, step = self._walk(keys, level, np.uint64(size))
            for _ in range(PROBES):
                bits[place.view(np.int64)] = True
                place = self._next(place, step, np.uint64(size))
        self.bits, self.starts = np.packbits(bits, bitorder="little"), np.array([0, size // 8])

    @classmethod
    def joined(cls, segments: list[bytes]) -> LogFrequencyFilter:
        out = cls.__new__(cls)
        out.bits, out.starts = np.frombuffer(b"".join(segments), np.uint8), np.cumsum([0, *map(len, segments)])
        return out

    @staticmethod
    def _walk(keys: np.ndarray, level: int, size) -> tuple[np.ndarray, np.ndarray]:
        """First place and step of the probes of (key, level), wrapped to the segment."""
        with np.errstate(over="ignore"):
            x = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
        return (x & np.uint64(0xFFFFFFFF)) % size, ((x >> np.uint64(32)) | np.uint64(1)) % size

    @staticmethod
    def _next(place: np.ndarray, step: np.ndarray, size) -> np.ndarray:
        place = place + step
        with np.errstate(over="ignore"):  # below size, the difference wraps to a huge number
            return np.minimum(place, place - size)

    def _set(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[(place >> np.uint64(3)).view(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    def levels(self, keys: np.ndarray, segments: np.ndarray | int = 0) -> np.ndarray:
        """The level of each key, read from its segment; now and then too high by one or more, never too low."""
        out = np.zeros(len(keys), np.uint8)
        starts, sizes = self.starts[:-1].astype(np.uint64) * np.uint64(8), np.diff(self.starts).astype(np.uint64) * np.uint64(8)
        alone = len(sizes) == 1
        segments = np.zeros(0, np.int64) if alone else np.broadcast_to(segments, len(keys))
        alive, level = np.arange(len(keys)), 0
        while len(alive):
            start, size = (np.uint64(0), sizes[0]) if alone else (starts[segments[alive]], sizes[segments[alive]])
            place, step = self._walk(keys[alive], level + 1, size)
            found = self._set(start + place)
            place = self._next(place, step, size)
            found &= self._set(start + place)
            # few of those that are missing come so far
            alive, place, step = alive[found], place[found], step[found]
            start, size = (start, size) if alone else (start[found], size[found])
            found = np.ones(len(alive), bool)
            for _ in range(PROBES - 2):
                place = self._next(place, step, size)
                found &= self._set(start + place)
            alive, level = alive[found], level + 1
            out[alive] = level
        return out


@dataclass
class Trained:
    """Segments of the filter, by number, and the counts of their words."""

    segment_bits: int
    numbers: np.ndarray
    filter: LogFrequencyFilter
    words: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows, segment_bits: int) -> Trained:
        """From the written rows (segment, bits, words, words_n), in any order."""
        rows = rows.sort_by("segment")
        # a word's first bits are its segment's number, so all words are in ascending order
        words, counts = _flat(rows.column("words"), "<u8")[0], _flat(rows.column("words_n"), "<i8")[0]
        return cls(segment_bits, rows.column("segment").to_numpy(), LogFrequencyFilter.joined(rows.column("bits").to_pylist()), words, counts)

    def read(self, words: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words, levels of words and levels of longer n-grams."""
        counts = np.zeros(len(words), np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            counts = np.where(self.words[at] == words, self.counts[at], 0)
        own = np.concatenate([_word_segments(words, self.segment_bits), _gram_segments(grams, self.segment_bits)]).astype(np.int64)
        levels = np.zeros(len(own), np.uint8)
        if len(self.numbers):  # a segment without training n-grams is not there
            at = np.minimum(np.searchsorted(self.numbers, own), len(self.numbers) - 1)
            there = self.numbers[at] == own
            levels[there] = self.filter.levels(np.concatenate([_gram_key(words), grams])[there], at[there])
        return counts, levels[: len(words)], levels[len(words) :]


def _word_segments(words: np.ndarray, segment_bits: int) -> np.ndarray:
    return words >> np.uint64(64 - segment_bits)


def _gram_segments(grams: np.ndarray, segment_bits: int) -> np.ndarray:
    return grams >> np.uint64(KEY_BITS - segment_bits)


def _numbered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, of so many bits, in ascending order, and of each key its place there.

    Integers are sorted many times faster by themselves than by index, so the key's first bits and its index are sorted as one
    integer; if keys that differ share those bits, they are sorted by index after all."""
    index_bits = max(1, (len(keys) - 1).bit_length())
    cut = np.uint64(max(0, bits + index_bits - 64))
    packed = np.sort(keys >> cut << np.uint64(index_bits) | np.arange(len(keys), dtype=np.uint64))
    by_key = (packed & np.uint64((1 << index_bits) - 1)).view(np.int64)
    ordered = keys[by_key]
    if (ordered[1:] < ordered[:-1]).any():
        by_key = np.argsort(keys)
        ordered = keys[by_key]
    new = _changes(ordered)
    places = np.empty(len(keys), np.int32)
    places[by_key] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], places


def _changes(ordered: np.ndarray) -> np.ndarray:
    """Which values of an ascending array differ from the one before."""
    return np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[_changes(keys)]


@dataclass
class Counted:
    """Distinct keys in ascending order, and their counts."""

    keys: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> Counted:
        keys = np.sort(keys)
        starts = np.flatnonzero(_changes(keys))
        return cls(keys[starts], np.diff(np.r_[starts, len(keys)]))

    @classmethod
    def summed(cls, keys: np.ndarray, counts: np.ndarray) -> Counted:
        by_key = np.argsort(keys, kind="stable")  # which merges ascending runs
        return cls._runs(keys[by_key], counts[by_key])

    @classmethod
    def unpacked(cls, packed: np.ndarray) -> Counted:
        """From entries of longer n-grams, see ``packed``, in any order; they are sorted where they stand."""
        packed.sort()
        return cls._runs(packed >> np.uint64(64 - KEY_BITS), packed.astype(np.uint16))

    @classmethod
    def _runs(cls, keys: np.ndarray, counts: np.ndarray) -> Counted:
        starts = np.flatnonzero(_changes(keys))
        return cls(keys[starts], np.add.reduceat(counts, starts, dtype=np.int64) if len(keys) else counts.astype(np.int64))

    def split(self, most: int) -> Counted:
        """The same counts in entries of at most so much."""
        if self.counts.max(initial=0) <= most:
            return self
        times = np.maximum(1, -(-self.counts // most))
        counts = np.full(int(times.sum()), most)
        counts[np.cumsum(times) - 1] = self.counts - (times - 1) * most
        return Counted(np.repeat(self.keys, times), counts)

    def packed(self) -> np.ndarray:
        """Entries of longer n-grams as one integer each: the key, and a count of 16 bits."""
        own = self.split(MOST_GRAMS)
        return own.keys << np.uint64(64 - KEY_BITS) | own.counts.astype(np.uint64)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _in_turn(segments: np.ndarray, turn: int) -> np.ndarray:
    return segments % np.uint64(ROUNDS) == turn


def _binary(values: np.ndarray, cuts: np.ndarray):
    """An Arrow column of byte strings: values between one cut and the next."""
    import pyarrow as pa

    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all byte strings of a column, and the cuts between the strings."""
    import pyarrow as pa

    whole = column.cast(pa.large_binary())
    whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, whole.offset * 8)
    data = whole.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b""
    return np.frombuffer(data, kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


@dataclass
class Chunk:
    """Rows whose texts are read: (id, held_out), where each row's tokens start and the last end, distinct words in ascending order,
    and each token's place among them."""

    rows: object
    first: np.ndarray
    words: np.ndarray
    places: np.ndarray

    SCHEMA: ClassVar[str] = "rows binary, sizes binary, words binary, places binary"

    @classmethod
    def of(cls, rows, texts) -> Chunk:
        hashes, sizes = [], []
        for _, _, own, first in tokens(*column_bytes(texts)):
            hashes.append(own)
            sizes.append(np.diff(first))
        return cls(rows, np.cumsum(np.r_[0, np.concatenate(sizes)]), *_numbered(np.concatenate(hashes), 64))

    def written(self) -> list[bytes]:
        import pyarrow as pa
        import zstandard

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rows.schema) as stream:
            stream.write_batch(self.rows)
        # bytes of one weight together, which packs better
        planes = np.ascontiguousarray(self.places.view(np.uint8).reshape(-1, 4).T)
        pack = zstandard.ZstdCompressor(level=1).compress
        return [pack(sink.getvalue()), pack(np.diff(self.first).astype(np.uint32)), self.words.tobytes(), pack(planes)]

    @classmethod
    def read(cls, rows, sizes, words, places) -> Chunk:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        planes = np.frombuffer(unpack(places), np.uint8).reshape(4, -1)
        return cls(
            pa.ipc.open_stream(unpack(rows)).read_next_batch(), np.cumsum(np.r_[0, np.frombuffer(unpack(sizes), np.uint32).astype(np.int64)]),
            np.frombuffer(words, np.uint64), np.ascontiguousarray(planes.T).view(np.int32).reshape(-1),
        )

    def grams(self, order: int) -> Iterator[np.ndarray]:
        """Keys of the n-grams that end at each token, for n = 2 to order."""
        return ngram_keys(self.words[self.places], self.first, order)

    def counted(self, order: int, segment_bits: int, turn: int) -> tuple[Counted, Counted]:
        """Counts of the words and of the longer n-grams of rows to learn from, of the segments whose turn it is."""
        train = np.repeat(~self.rows.column("held_out").to_numpy(zero_copy_only=False), np.diff(self.first))
        n = np.bincount(self.places[train], minlength=len(self.words))
        n[~_in_turn(_word_segments(self.words, segment_bits), turn)] = 0
        grams = _joined([x[train & _in_turn(_gram_segments(x, segment_bits), turn)] for x in self.grams(order)])
        return Counted(self.words[n > 0], n[n > 0]), Counted.of(grams)

    def asked(self, order: int, segment_bits: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words and longer n-grams of the segments whose turn it is, in ascending order."""
        grams = _joined([x[_in_turn(_gram_segments(x, segment_bits), turn)] for x in self.grams(order)])
        return self.words[_in_turn(_word_segments(self.words, segment_bits), turn)], _distinct(grams)


def _chunks(slim: DataFrame) -> DataFrame:
    """(chunk, rows, sizes, words, places): rows of (id, held_out, text) packed together."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        names = ["chunk", *(x.split()[0] for x in Chunk.SCHEMA.split(", "))]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(np.cumsum(np.r_[0, sizes.astype(np.int64)]).tolist(), CHUNK_BYTES):
                own = batch.slice(a, b - a)
                chunk = Chunk.of(pa.RecordBatch.from_arrays(own.columns[:2], ["id", "held_out"]), own.column(2))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row, *chunk.written())], names)
                row += 1

    return slim.mapInArrow(pack, f"chunk long, {Chunk.SCHEMA}")


def _read(batch) -> Iterator[tuple[int, Chunk]]:
    """Numbers and chunks of a batch of written rows, one at a time."""
    for i in range(len(batch)):
        number, *parts = (batch.column(k)[i] for k in range(5))
        yield number.as_py(), Chunk.read(*(x.as_buffer() for x in parts))


_COUNTS = "segment long, part long, words binary, words_n binary, low binary, high binary, grams_n binary"


def _sent(words: np.ndarray, grams: np.ndarray, segment_bits: int) -> tuple[np.ndarray, list[np.ndarray], list]:
    """Segments of ascending keys, where each segment's keys are cut, and columns of the keys: words, and the low 32 and
    the high 16 bits of longer n-grams."""
    own = _word_segments(words, segment_bits), _gram_segments(grams, segment_bits)
    segments = _distinct(np.concatenate([x[_changes(x)] for x in own]))
    at = [np.r_[np.searchsorted(x, segments), len(x)] for x in own]
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint16)
    return segments.astype(np.int64), at, [_binary(words, at[0]), _binary(low, at[1]), _binary(high, at[1])]


def _received(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and longer n-grams of the rows of a table, and the cuts between rows."""
    words, at_words = _flat(table.column("words"), "<u8")
    low, at_grams = _flat(table.column("low"), "<u4")
    return words, _flat(table.column("high"), "<u2")[0].astype(np.uint64) << np.uint64(32) | low, at_words, at_grams


def _counted(chunks: DataFrame, order: int, segment_bits: int, turn: int) -> DataFrame:
    """Counts of the n-grams of chunks in segments whose turn it is: a row for each segment whenever a task holds HELD_GRAMS, and
    at its end. Held counts are entries of one integer each, which are sorted and added up when they are sent."""

    def rows(held: list[Counted], packed: list[np.ndarray], part: int):
        import pyarrow as pa

        words = Counted.summed(_joined([x.keys for x in held]), np.concatenate([x.counts for x in held])).split(MOST_WORDS)
        grams = Counted.unpacked(_joined(packed)).split(MOST_GRAMS)
        segments, at, keys = _sent(words.keys, grams.keys, segment_bits)
        words_n, grams_n = _binary(words.counts.astype(np.uint32), at[0]), _binary(grams.counts.astype(np.uint16), at[1])
        columns = [pa.array(segments), pa.array(np.full(len(segments), part)), keys[0], words_n, keys[1], keys[2], grams_n]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _COUNTS.split(", ")])

    def count(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, held, packed = TaskContext.get().partitionId(), [], []
        for batch in batches:
            for _, chunk in _read(batch):
                words, grams = chunk.counted(order, segment_bits, turn)
                held.append(words)
                packed.append(grams.packed())
                if sum(map(len, packed)) >= HELD_GRAMS:
                    yield rows(held, packed, part)
                    held, packed = [], []
        if held:
            yield rows(held, packed, part)

    return chunks.mapInArrow(count, _COUNTS)


def _sums(table) -> tuple[Counted, Counted]:
    words, grams, _, _ = _received(table)
    packed = grams << np.uint64(64 - KEY_BITS) | _flat(table.column("grams_n"), "<u2")[0]
    return Counted.summed(words, _flat(table.column("words_n"), "<u4")[0]), Counted.unpacked(packed)


def _met(counted: DataFrame, groups: int) -> DataFrame:
    """The same counts in at most ``groups`` rows a segment, so that no segment gets a row of every task."""

    def add(table):
        import pyarrow as pa

        words, grams = _sums(table)
        words, grams = words.split(MOST_WORDS), grams.split(MOST_GRAMS)
        whole = [np.array([0, len(x.keys)]) for x in (words, grams)]
        low, high = grams.keys.astype(np.uint32), (grams.keys >> np.uint64(32)).astype(np.uint16)
        columns = [_binary(words.keys, whole[0]), _binary(words.counts.astype(np.uint32), whole[0])]
        columns += [_binary(low, whole[1]), _binary(high, whole[1]), _binary(grams.counts.astype(np.uint16), whole[1])]
        return pa.table([table.column("segment").slice(0, 1), table.column("part").slice(0, 1), *columns], [x.split()[0] for x in _COUNTS.split(", ")])

    return counted.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("segment", "part").applyInArrow(add, _COUNTS)


def _segments(counted: DataFrame) -> DataFrame:
    """(segment, bits, words, words_n, n, v, load): the bits of a segment, its words and their counts, its number of training
    tokens and of distinct ones, and the bytes of counts that came."""

    def build(table):
        import pyarrow as pa

        words, grams = _sums(table)
        keys, counts = np.concatenate([_gram_key(words.keys), grams.keys]), np.concatenate([words.counts, grams.counts])
        bits = LogFrequencyFilter(keys, level_of(counts)).bits.tobytes()
        return pa.table({
            "segment": table.column("segment").slice(0, 1), "bits": [bits], "words": [words.keys.tobytes()], "words_n": [words.counts.tobytes()],
            "n": [int(words.counts.sum())], "v": [len(words.keys)], "load": [table.nbytes],
        })

    schema = "segment long, bits binary, words binary, words_n binary, n long, v long, load long"
    return counted.groupBy("segment").applyInArrow(build, schema)


def _asked(chunks: DataFrame, order: int, segment_bits: int, turn: int) -> DataFrame:
    """(chunk, segment, words, low, high): the keys that a chunk has in a segment whose turn it is, in ascending order."""

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for number, chunk in _read(batch):
                segments, _, columns = _sent(*chunk.asked(order, segment_bits, turn), segment_bits)
                columns = [pa.array(np.full(len(segments), number)), pa.array(segments), *columns]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "segment", "words", "low", "high"])

    return chunks.mapInArrow(ask, "chunk long, segment long, words binary, low binary, high binary")


def _answered(asked: DataFrame, segments: DataFrame, segment_bits: int, most: int) -> DataFrame:
    """(chunk, segment, counts, word_levels, gram_levels), in the order in which they were asked. What a segment's bits and
    word counts say; a segment that takes more than ASKED_BYTES is copied, ``most`` times at most."""
    copies = F.greatest(F.lit(1), F.ceil(F.col("load") / ASKED_BYTES))
    if most > 1:
        hot = segments.select("segment", copies.alias("copies")).filter("copies > 1")
        asked = asked.join(hot, "segment", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("chunk"), "copies"), F.lit(0).cast("long")))
    else:
        asked = asked.withColumn("copy", F.lit(0).cast("long"))
    held = segments.select("segment", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), "bits", "words", "words_n")

    def answer(rows, own):
        import pyarrow as pa

        words, grams, at_words, at_grams = _received(rows)
        counts, word_levels, gram_levels = Trained.of(own, segment_bits).read(words, grams)
        columns = [_binary(counts, at_words), _binary(word_levels, at_words), _binary(gram_levels, at_grams)]
        return pa.table([rows.column("chunk"), rows.column("segment"), *columns], ["chunk", "segment", "counts", "word_levels", "gram_levels"])

    schema = "chunk long, segment long, counts binary, word_levels binary, gram_levels binary"
    return asked.groupBy("segment", "copy").cogroup(held.groupBy("segment", "copy")).applyInArrow(answer, schema)


@dataclass
class Model:
    """The smoothing over levels that were read from the filter."""

    order: int
    train_docs: int
    train_tokens: int
    train_words: int

    def token_log10(self, levels: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """log10 of each token's smoothed probability after the tokens before it; levels: for each order those of the
        n-grams that end at each token."""
        values = level_values()
        opens = np.zeros(len(levels[0]), bool)
        opens[first[:-1]] = True
        held = values[levels[0]]
        p = (held + ADDED) / (self.train_tokens + ADDED * (self.train_words + 1))
        for n in range(2, self.order + 1):
            context = np.r_[0.0, held[:-1]]
            context[opens] = self.train_docs
            # no n-gram is more frequent than its parts: what exceeds them is a false hit
            held = np.minimum(values[levels[n - 1]], np.minimum(held, context))
            prior = PRIORS[min(n - 2, len(PRIORS) - 1)]
            p = (held + prior * p) / (context + prior)
        return np.log10(np.minimum(p, 1.0))


def _scored(model: Model, chunk: Chunk, read: Callable) -> list:
    """The result's columns for a chunk; read gives counts of words, their levels and those of longer n-grams, for distinct keys in
    ascending order."""
    import pyarrow as pa

    grams, at_grams = _numbered(_joined(list(chunk.grams(model.order))), KEY_BITS)
    counts, word_levels, gram_levels = read(chunk.words, grams)
    longer = gram_levels[at_grams].reshape(model.order - 1, -1)
    whole = math.log10(model.train_tokens + ADDED * (model.train_words + 1))
    known, base = counts > 0, np.log10(counts + ADDED) - whole
    score = model.token_log10([word_levels[chunk.places], *longer], chunk.first)
    starts = chunk.first[:-1]
    sums = [np.add.reduceat(x, starts, dtype=k) for x, k in ((known[chunk.places], np.int64), (base[chunk.places], np.float64), (score, np.float64))]
    trained = np.full(len(starts), model.train_tokens)
    return [*chunk.rows.columns, *map(pa.array, (np.diff(chunk.first), sums[0], trained, *sums[1:]))]


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = ORDER,
    segment_grams: int = SEGMENT_GRAMS, broadcast_bytes: int = BROADCAST_BYTES, met_rows: int = MET_ROWS,
) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose fold (see ``langid.fold``) is not 0 and scores all. Null and empty texts have one
    token, the end. base_score is exact; score is the model's, whose filter holds every n-gram of every training text
    up to the order: what is gathered grows with the input. The filter is broadcast while it has at most
    broadcast_bytes, which is checked, else asked by segment; rows are the same both ways, and depend on the number of segments
    by false hits alone. Texts are read whole; one longer than a chunk is a chunk of its
    own and takes about twenty times its size in a worker. Repeated rows count and are scored as often as they stand;
    without training rows all counts are 0. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    slim = docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == 0).alias("held_out"), F.col(text_col).alias("text"))
    train = slim.filter(~F.col("held_out"))
    size, n_train = train.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    segment_bits = min(32, max(1, math.ceil(math.log2(1 + size / TOKEN_BYTES * order / segment_grams))))
    groups = math.ceil((size / CHUNK_BYTES + 1) / met_rows)
    chunks = scratch.table(_chunks(slim), FILE_CHUNKS)
    built = []
    for turn in range(ROUNDS):
        counted = _counted(chunks, order, segment_bits, turn)
        built.append(scratch.table(_segments(_met(counted, groups) if groups > 1 else counted)))
    segments = reduce(DataFrame.unionByName, built)
    total = F.sum(F.octet_length("bits").cast("long") + F.octet_length("words") + F.octet_length("words_n"))
    n, v, held, load = segments.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("v"), total, F.max("load"))]).first()
    model = Model(order, n_train, n, v)

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [docs.schema[id_col].dataType, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    if held <= broadcast_bytes:
        known = spark.sparkContext.broadcast(Trained.of(segments.select("segment", "bits", "words", "words_n").toArrow(), segment_bits))

        def probe(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for _, chunk in _read(batch):
                    yield pa.RecordBatch.from_arrays(_scored(model, chunk, known.value.read), names)

        return chunks.mapInArrow(probe, schema).withColumnRenamed("id", id_col)

    answers = []
    for turn, own in enumerate(built):
        answers.append(scratch.table(_answered(_asked(chunks, order, segment_bits, turn), own, segment_bits, math.ceil(load / ASKED_BYTES))))
        scratch.drop(own)

    def run(chunk, answer):
        import pyarrow as pa

        answer = answer.sort_by("segment")
        read = [_flat(answer.column(c), k)[0] for c, k in (("counts", "<i8"), ("word_levels", "u1"), ("gram_levels", "u1"))]
        _, own = next(_read(chunk.combine_chunks().to_batches()[0]))
        return pa.Table.from_arrays(_scored(model, own, lambda *_: read), names)

    read = reduce(DataFrame.unionByName, answers)
    return chunks.groupBy("chunk").cogroup(read.groupBy("chunk")).applyInArrow(run, schema).withColumnRenamed("id", id_col)
