"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can come last in the prefix's encoding. ``PrefixTable`` stores
that token for each prefix: the next prefix's token is the one token ending there that may follow the token
stored where it begins. The encoding is read off backwards. Appending bytes extends the table; an edit recomputes
it from the edit on and stops as soon as old and new entries agree over the reach of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.hashing import column_bytes, distinct_slices, slices

#: Bytes of a worker's memo of pieces, about, and entries of its memo of token pairs (about 100 bytes each). A full
#: memo is emptied, which costs time but changes no result.
MEMO_BYTES, PAIRS = 48 << 20, 150_000
#: Text that is cut into pieces at a time.
PART_BYTES = 1 << 20


class Vocabulary:
    """Token bytes and ranks, with the merges that the ranks imply."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._follows: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge, the last one, makes the token."""
        whole = self.bytes_of[token]
        parts = [whole[i : i + 1] for i in range(len(whole))]
        rank, none = self.ranks.get, 1 << 40
        while len(parts) > 2:
            best, at = min((rank(x + y, none), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if best == none:
                raise ValueError("a token that no merges make")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's left (0) or right (1) edge while it is built up, from a byte to the whole.

        Each with the rank at which it is merged into the next; the whole is never merged.
        """
        known = self._spines[side].get(token)
        if known is None:
            inner = []
            if len(self.bytes_of[token]) > 1:
                half = self._halves(token)[side]
                inner = [*self._spine(half, side)[:-1], (self.bytes_of[half], token)]
            known = self._spines[side][token] = [*inner, (self.bytes_of[token], 1 << 40)]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined bytes are encoded as just these two tokens.

        They are unless some merge across the border comes before the merges that take its two sides up. Of two
        merges of one rank the left one comes first.
        """
        key = left << 32 | right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= PAIRS:
                self._follows.clear()
            known = self._follows[key] = self._stay_apart(self._spine(left, 1), self._spine(right, 0))
        return known

    def _stay_apart(self, left: list[tuple[bytes, int]], right: list[tuple[bytes, int]]) -> bool:
        rank, i, j = self.ranks.get, 0, 0
        while True:
            (x, x_up), (y, y_up) = left[i], right[j]
            across = rank(x + y)
            if across is not None and across < x_up and across <= y_up:
                return False
            if x_up <= y_up:
                i += 1
                if i == len(left):
                    return True
            else:
                j += 1


def _extend(vocabulary: Vocabulary, data: bytes, last: list[int], upto: int) -> None:
    """Appends to last the tokens of the prefixes of data up to length upto."""
    rank, known, longest = vocabulary.ranks.get, vocabulary._follows.get, vocabulary.longest
    for i in range(len(last), upto + 1):
        for begin in range(i - longest if i > longest else 0, i):
            token = rank(data[begin:i])
            if token is not None:
                if not begin:
                    break
                follows = known(last[begin] << 32 | token)
                if follows or (follows is None and vocabulary.may_follow(last[begin], token)):
                    break
        else:
            raise ValueError("the vocabulary lacks a byte")
        last.append(token)


def _read_back(vocabulary: Vocabulary, last: list[int]) -> list[int]:
    out, i, bytes_of = [], len(last) - 1, vocabulary.bytes_of
    while i:
        token = last[i]
        out.append(token)
        i -= len(bytes_of[token])
    out.reverse()
    return out


class PrefixTable:
    """The encoding of a byte string that grows at its end or changes inside."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        _extend(self.vocabulary, self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of data[start:end]; returns how many entries were computed anew."""
        old_last, old_size = self.last, len(self.data)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old_last[: start + 1]
        moved, same, computed = len(self.data) - old_size, 0, 0
        while len(self.last) <= len(self.data):
            i = len(self.last)
            _extend(self.vocabulary, self.data, self.last, i)
            computed += 1
            # old entries count as equal only for prefixes that end after the edit
            same = same + 1 if i > start + len(new) and self.last[i] == old_last[i - moved] else 0
            if same >= self.vocabulary.longest:
                self.last += old_last[i - moved + 1 :]
        return computed

    def ids(self) -> list[int]:
        return _read_back(self.vocabulary, self.last)


class Memo(dict):
    """What is known of pieces; emptied when it holds more than so many bytes, about."""

    #: Bytes of an entry besides its piece and its ids.
    ENTRY = 140

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most_bytes = self.room = most_bytes

    def make_room(self, pieces: int, data_bytes: int) -> bool:
        """Whether the memo had to be emptied to take so many more pieces."""
        self.room -= self.ENTRY * pieces + data_bytes
        if self.room >= 0 or not self:
            return False
        self.clear()
        self.room = self.most_bytes
        return True

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and each piece's number of ids."""
        raise NotImplementedError


class Pieces(Memo):
    """Piece bytes -> token ids, computed when first asked for."""

    def __init__(self, vocabulary: Vocabulary, most_bytes: int = MEMO_BYTES):
        super().__init__(most_bytes)
        self.vocabulary = vocabulary

    def of_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each of many pieces. New ones are taken in byte order, so that a piece starts from the table of
        the one before it, as far as the two begin alike."""
        new = sorted(x for x in pieces if x not in self)
        if self.make_room(len(new), 9 * sum(map(len, new)) // 2):
            new = sorted(pieces)
        rank, data, last = self.vocabulary.ranks.get, b"", [-1]
        for piece in new:
            whole = rank(piece)
            if whole is None:
                same, most = 0, min(len(data), len(piece))
                while same < most and data[same] == piece[same]:
                    same += 1
                del last[same + 1 :]
                _extend(self.vocabulary, piece, last, len(piece))
                data = piece
            self[piece] = (whole,) if whole is not None else tuple(_read_back(self.vocabulary, last))
        return list(map(self.__getitem__, pieces))

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.of_all(pieces)
        return np.array(list(chain.from_iterable(found)), np.uint32), np.array(list(map(len, found)), np.int64)

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            ids = (whole,)
        else:
            last = [-1]
            _extend(self.vocabulary, piece, last, len(piece))
            ids = tuple(_read_back(self.vocabulary, last))
        self.make_room(1, len(piece) + 8 * len(ids))
        self[piece] = ids
        return ids


# The classes of characters that the split pattern tells apart.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The endings that the split pattern keeps together with an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    # what the standard's White_Space property holds; U+001C to U+001F are not among it
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[[ord(c) for c in m[0]]] = kind
    return table


def split_points(data: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pieces of the split pattern start in the texts of a buffer, and each text's first piece.

    The same pieces as the pattern's matches from left to right, found for all texts at once: runs of one
    character class; a run takes the one U+0020 before it along; of other white space before a run, all but its
    last character is a piece; an apostrophe that no U+0020 precedes takes a contraction's letters along.
    """
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at_byte = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=at_byte[1:])
    text_at = np.searchsorted(at_byte, np.asarray(offsets, np.int64))  # in characters
    opens = np.zeros(n + 1, bool)
    opens[text_at] = True
    opens[n] = True
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _classes()[points]
    runs = opens[:n].copy()
    runs[1:] |= kind[1:] != kind[:-1]
    is_space = kind == SPACE
    blank = points == 32
    starts = runs.copy()
    # a run after U+0020 of the same text starts with it
    after_blank = runs & ~is_space & ~opens[:n]
    after_blank[1:] &= blank[:-1]
    after_blank[0] = False
    starts[after_blank] = False
    # the last of two and more white-space characters before a run starts a piece
    ends_space = is_space.copy()
    ends_space[:-1] &= ~is_space[1:] & ~opens[1:n]
    ends_space[-1] = False
    starts |= ends_space
    quote = np.flatnonzero((points == 39) & runs & ~after_blank)
    for ending in CONTRACTIONS:
        size = len(ending)
        hit = quote[quote + size < n]
        for k, c in enumerate(ending, 1):
            hit = hit[(points[hit + k] == ord(c)) & ~opens[hit + k]]
        starts[hit + 1] = False
        beyond = hit + size + 1
        inside = beyond < n
        beyond = beyond[inside]
        beyond = beyond[(kind[beyond] == LETTER) & ~opens[beyond]]
        starts[beyond] = True
    piece = np.flatnonzero(starts)
    return at_byte[piece], np.searchsorted(piece, text_at)


def parts(data: bytes, offsets: list[int], part_bytes: int = PART_BYTES) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """For runs of texts of a buffer: the distinct pieces, each piece's number among those, and each text's first piece
    and the end."""
    for a, b in slices(offsets, part_bytes):
        part = data[offsets[a] : offsets[b]]
        starts, first = split_points(part, [x - offsets[a] for x in offsets[a : b + 1]])
        ends = np.append(starts[1:], len(part))[: len(starts)]
        chosen, own = distinct_slices(part, starts, ends - starts)
        yield [part[s:e] for s, e in zip(starts[chosen].tolist(), ends[chosen].tolist())], own, first


def encoded(data: bytes, offsets: list[int], memo: Memo, part_bytes: int = PART_BYTES) -> Iterator[np.ndarray]:
    """The token ids of each text of a buffer."""
    for pieces, own, first in parts(data, offsets, part_bytes):
        ids, sizes = memo.ids_of(pieces)
        begin, n = np.cumsum(sizes) - sizes, sizes[own]
        upto = np.r_[0, np.cumsum(n)]
        flat = ids[np.repeat(begin[own] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[first].tolist()
        for i, j in zip(cuts, cuts[1:]):
            yield flat[i:j]


def _each(values: list, own: np.ndarray) -> list:
    table = np.empty(len(values), object)
    table[:] = values
    return table[own].tolist()


class EditableText:
    """A text's encoding under appends and edits: only pieces near the change are split and encoded anew."""

    #: A match looks at most this many characters beyond its own end (an apostrophe and two letters).
    LOOK = 3

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        import regex

        self.pattern, self.pieces_of = regex.compile(pattern), Pieces(vocabulary)
        self.text, self.pieces = "", []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        old, moved = self.pieces, len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        keep, at = 0, 0
        while keep < len(old) and at + len(old[keep]) + self.LOOK <= start:
            at += len(old[keep])
            keep += 1
        then, there = keep, at + moved  # old pieces at their new places
        fresh = []
        while at < len(self.text):
            while then < len(old) and there < at:
                there += len(old[then])
                then += 1
            if at >= start + len(new) and there == at and then < len(old):
                break
            piece = self.pattern.match(self.text, at)[0]
            fresh.append(piece)
            at += len(piece)
        self.pieces = old[:keep] + fresh + (old[then:] if at < len(self.text) else [])

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.pieces_of[p.encode()] for p in self.pieces))


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    """One memo per worker process and vocabulary, kept between its tasks."""
    return Pieces(Vocabulary.from_file(path))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): token ids of each whole text; null counts as empty and gives an empty list.

    vocabulary_path is a rank file that every worker can open. One row per row of docs, repeated rows included;
    other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = _pieces(vocabulary_path)
        for batch in batches:
            ids = [x.astype(np.int32) for x in encoded(*column_bytes(batch.column(1)), pieces)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return rows.select(F.col("id").alias(id_col), "ids")


def decode_bytes(ids: list[int], vocabulary: Vocabulary) -> bytes:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids))


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): ``encode`` and ``decode_bytes`` where the text stands.

    Token lists never leave the worker, so nothing is shuffled and no row is wider than its digests. Null and empty
    texts have no tokens and the digests of nothing; a very long text is read whole and takes about thirty times its
    size in a worker. One row per row of docs, repeated rows included; other columns are not read; an empty table gives
    no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = _pieces(vocabulary_path)
        names = {i: b"%d" % i for i in pieces.vocabulary.bytes_of}
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for distinct, own, first in parts(*column_bytes(batch.column(1))):
                ids = pieces.of_all(distinct)
                written = _each([b" ".join(map(names.__getitem__, x)) for x in ids], own)
                decoded = _each([decode_bytes(x, pieces.vocabulary) for x in ids], own)
                upto = np.r_[0, np.cumsum(np.array(list(map(len, ids)), np.int64)[own])][first]
                n += np.diff(upto).tolist()
                for i, j in zip(first.tolist(), first.tolist()[1:]):
                    ids_sha.append(sha(b" ".join(written[i:j])))
                    text_sha.append(sha(b"".join(decoded[i:j])))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))
    return rows.withColumnRenamed("id", id_col)
