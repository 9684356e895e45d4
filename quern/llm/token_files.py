"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file (all integers little-endian)::

    magic "QTOK" | version u8 | bytes per id u8
    frames       zstandard frames, each the ids of whole documents one after another
    seek table   a zstandard frame that holds
                 per frame: offset u64, stored bytes u32, crc32 of the stored bytes u32, ids u64, documents u32
                 per document: its number of ids u32; then per document: its key i64 (0 for a null key)
    tail         offset of the seek table u64, stored bytes u32, crc32 u32, frames u32, documents u64,
                 documents without a key u64 (they come first), magic "QTOK"

A reader that wants some documents reads the tail, the seek table, and only the frames that hold them.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import Memo, encoded
from quern.llm.hashing import column_bytes
from quern.sources.scratch import Scratch

MAGIC, VERSION = b"QTOK", 1
HEAD, FRAME, TAIL = struct.Struct("<4sBB"), struct.Struct("<QIIQI"), struct.Struct("<QIIIQQ4s")
#: A frame is closed at the first document end beyond this many ids.
FRAME_IDS = 1 << 18
#: Text of a file, about: there are more files than shuffle partitions only beyond that.
FILE_BYTES = 64 << 20


def _filesystem(uri: str):
    """The file system of a folder's URI and the path in it; executors and driver reach the same files."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; holds one frame's ids and twelve bytes per document."""

    def __init__(self, stream, id_bytes: int):
        import zstandard

        self.stream, self.kind = stream, np.dtype(f"<u{id_bytes}")
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.at, self.frames, self.lengths, self.keys, self.keyless = HEAD.size, [], [], [], 0
        self.open_, self.open_ids, self.open_docs = [], 0, 0
        stream.write(HEAD.pack(MAGIC, VERSION, id_bytes))

    def add(self, key: int | None, ids: np.ndarray) -> None:
        """Documents without a key must come first."""
        self.keyless += key is None
        self.keys.append(key or 0)
        self.open_.append(ids.astype(self.kind))
        self.lengths.append(len(ids))
        self.open_ids += len(ids)
        self.open_docs += 1
        if self.open_ids >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.open_docs:
            stored = self.zstd.compress(np.concatenate(self.open_).tobytes())
            self.frames.append(FRAME.pack(self.at, len(stored), zlib.crc32(stored), self.open_ids, self.open_docs))
            self.stream.write(stored)
            self.at += len(stored)
            self.open_, self.open_ids, self.open_docs = [], 0, 0

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        self._flush()
        table = self.zstd.compress(b"".join(self.frames) + np.array(self.lengths, "<u4").tobytes() + np.array(self.keys, "<i8").tobytes())
        self.stream.write(table)
        self.stream.write(TAIL.pack(self.at, len(table), zlib.crc32(table), len(self.frames), len(self.lengths), self.keyless, MAGIC))
        return len(self.lengths), sum(self.lengths)


class FrameReader:
    """Random access to one file's documents."""

    def __init__(self, stream, size: int):
        self.stream = stream
        at, stored, crc, n_frames, n_docs, self.keyless, magic = TAIL.unpack(self._bytes(size - TAIL.size, TAIL.size))
        head_magic, version, id_bytes = HEAD.unpack(self._bytes(0, HEAD.size))
        if magic != MAGIC or head_magic != MAGIC or version != VERSION:
            raise ValueError("not a token file, or cut short")
        self.kind = np.dtype(f"<u{id_bytes}")
        table = self._frame(at, stored, crc)
        self.frames = [FRAME.unpack_from(table, i * FRAME.size) for i in range(n_frames)]
        self.lengths = np.frombuffer(table, "<u4", n_docs, n_frames * FRAME.size)
        self.keys = np.frombuffer(table, "<i8", n_docs, n_frames * FRAME.size + 4 * n_docs)
        self.first_doc = np.cumsum([0] + [f[4] for f in self.frames])

    def _bytes(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def _frame(self, at: int, stored: int, crc: int) -> bytes:
        import zstandard

        data = self._bytes(at, stored)
        if len(data) != stored or zlib.crc32(data) != crc:
            raise ValueError(f"the frame at byte {at} is damaged")
        return zstandard.ZstdDecompressor().decompress(data)

    def __len__(self) -> int:
        return len(self.lengths)

    def frame_documents(self, k: int) -> list[np.ndarray]:
        at, stored, crc, _, _ = self.frames[k]
        ids = np.frombuffer(self._frame(at, stored, crc), self.kind)
        a, b = self.first_doc[k], self.first_doc[k + 1]
        return np.split(ids, np.cumsum(self.lengths[a:b])[:-1])

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document; only its frame is read and decompressed."""
        k = int(np.searchsorted(self.first_doc, i, "right")) - 1
        return self.frame_documents(k)[i - self.first_doc[k]]


#: Bytes of a worker's memo, about; text that is cut into pieces at a time; pieces that the library gets at a time.
MEMO_BYTES, PART_BYTES, LINES = 128 << 20, 1 << 22, 1000


class LibraryPieces(Memo):
    """Piece bytes -> token ids as 32-bit integers in bytes, by the tokenizers library, asked once per distinct piece.

    The library splits a text at the tokenizer's added tokens and then into the same pieces, and encodes each on its own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(MEMO_BYTES)
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        added = {t.content.encode(): (i, t) for i, t in self.library.get_added_tokens_decoder().items() if t.content}
        #: Whether added tokens stand for themselves alone; else the library gets each text that holds one as a whole.
        self.plain = self.library.normalizer is None and not any(t.single_word or t.lstrip or t.rstrip or t.normalized for _, t in added.values())
        self.added = {content: np.array([i], np.uint32) for content, (i, _) in added.items()}
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        #: The id that stands between pieces that the library gets in one text, if an end of line is a token of its own.
        self.between = ids("\n")[0] if self.plain and len(ids("\n")) == 1 and ids("a\n b\nc") == ids("a") + ids("\n") + ids(" b") + ids("\n") + ids("c") else None
        longest_first = sorted(self.added, key=len, reverse=True)
        self.any_added = re.compile(b"|".join(map(re.escape, longest_first)) or rb"(?!)")

    def ids(self, data: bytes, offsets: list[int]) -> Iterator[np.ndarray]:
        """The ids of each text of a buffer, as the library gives them for the whole text."""
        if not self.any_added.search(data):
            yield from encoded(data, offsets, self, PART_BYTES)
            return
        cuts, own = [0], []  # ends of the parts of all texts; the ids of parts that are added tokens
        counts = []
        for s, e in zip(offsets, offsets[1:]):
            before, at = len(own), s
            for m in self.any_added.finditer(data, s, e) if self.plain else ():
                if m.start() > at:
                    cuts.append(m.start())
                    own.append(None)
                cuts.append(m.end())
                own.append(self.added[m[0]])
                at = m.end()
            if at < e or len(own) == before:
                cuts.append(e)
                whole = not self.plain and self.any_added.search(data, s, e)
                own.append(np.array(self.library.encode(data[s:e].decode(), add_special_tokens=False).ids, np.uint32) if whole else None)
            counts.append(len(own) - before)
        found = (ids if known is None else known for ids, known in zip(encoded(data, cuts, self, PART_BYTES), own))
        for n in counts:
            yield np.concatenate(list(islice(found, n)))

    def _learn(self, words: list[bytes]) -> None:
        """Of pieces that hold no white space but a U+0020 at their start: each is a line of one text. The end of line
        before a piece is a piece of its own, and no token of such a piece holds one, so it tells where a piece ends."""
        if self.between is None:
            return self._learn_each(words)
        ids = np.array(self.library.encode_batch_fast([b"\n".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.append(np.flatnonzero(ids == self.between), len(ids))
        if len(ends) != len(words):
            return self._learn_each(words)
        data = ids.tobytes()
        cuts = (4 * np.r_[-1, ends]).tolist()
        self.update((x, data[i + 4 : j]) for x, i, j in zip(words, cuts, cuts[1:]))

    def _learn_each(self, pieces: list[bytes]) -> None:
        batch = self.library.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False) if pieces else []
        self.update((x, array("I", e.ids).tobytes()) for x, e in zip(pieces, batch))

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.get, pieces))
        new = [x for x, ids in zip(pieces, found) if ids is None]
        if self.make_room(len(new), sum(map(len, new)) * 2):
            new = pieces
        words, spaces = [], []
        for x in new:
            (spaces if x.isspace() or x.decode().isspace() else words).append(x)
        for i in range(0, len(words), LINES):
            self._learn(words[i : i + LINES])
        self._learn_each(spaces)
        if new:
            found = list(map(self.__getitem__, pieces))
        return np.frombuffer(b"".join(found), np.uint32), np.array(list(map(len, found)), np.int64) // 4


@lru_cache(maxsize=2)
def _library(path: str) -> LibraryPieces:
    return LibraryPieces(path)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """Writes docs in ascending id order as token files in folder; returns the manifest, also written there.

    Null text counts as empty; end_id is appended to each document. Null ids come first; rows of one id follow
    each other in text order, so repeated rows make repeated documents and reruns make the same bytes. Each attempt of
    a task writes a file of its own name; the manifest names those of the attempts that count, and files of others are
    removed, so a task that is run again or twice does no harm and nothing is renamed. Texts are read whole; a very
    long one takes about thirty times its size in a worker. Other columns are not read. An empty table gives a manifest
    without files. The driver gets one row per file.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_BYTES))
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), "text"
    )

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, files = TaskContext.get().partitionId(), _filesystem(folder)
        pieces = _library(vocabulary_path)
        end = np.array([end_id], np.uint32)
        name, writer, stream = f"tokens-{shard:06d}-{uuid.uuid4().hex}.qtok", None, None
        for batch in batches:
            if not writer and batch.num_rows:
                stream = files[0].open_output_stream(f"{files[1]}/{name}")
                writer = FrameWriter(stream, 2 if max(pieces.size - 1, end_id) < 1 << 16 else 4)
            texts = pieces.ids(*column_bytes(batch.column(1)))
            for key, ids in zip(batch.column(0).to_pylist(), texts):
                writer.add(key, np.concatenate([ids, end]))
        if writer:
            n, ids = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "documents": [n], "ids": [ids]})

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    found = ordered.mapInArrow(write, "shard long, name string, documents long, ids long").collect()
    manifest, start, docs_before = {"files": []}, 0, 0
    for r in sorted(found, key=lambda r: r["shard"]):
        manifest["files"].append({"name": r["name"], "documents": r["documents"], "ids": r["ids"], "start": start})
        start, docs_before = start + r["ids"], docs_before + r["documents"]
    manifest |= {"ids": start, "documents": docs_before}
    files, path = _filesystem(folder)
    with files.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    named = {f["name"] for f in manifest["files"]}
    for left in files.get_file_info(fs.FileSelector(path)):
        if left.base_name.endswith(".qtok") and left.base_name not in named:
            files.delete_file(left.path)
    return manifest


def read_digests(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the files, one task a file.

    start counts the ids of all documents before; ids_crc32 is over the ids as unsigned 32-bit integers.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files, path = _filesystem(folder)
        for batch in batches:
            for name, start in zip(*(batch.column(k).to_pylist() for k in range(2))):
                size = files.get_file_info(f"{path}/{name}").size
                with files.open_input_file(f"{path}/{name}") as stream:
                    reader = FrameReader(stream, size)
                    for k in range(len(reader.frames)):
                        docs = reader.frame_documents(k)
                        n = np.array([len(d) for d in docs])
                        crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                        place = int(reader.first_doc[k]) + np.arange(len(docs))
                        keys = pa.array(reader.keys[place], pa.int64(), mask=place < reader.keyless)
                        columns = [keys, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32"])
                        start += int(n.sum())

    listed = spark.createDataFrame([(f["name"], f["start"]) for f in manifest["files"]], "name string, start long")
    if manifest["files"]:
        listed = listed.repartitionByRange(len(manifest["files"]), "start")
    return listed.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32): writes token files to a shared scratch folder and reads them back.

    Nulls, empty and very long texts, repeated rows and empty tables: see ``write_token_files``.
    """
    spark = docs.sparkSession
    folder = Scratch(spark, "tokens").path()
    manifest = write_token_files(docs, folder, vocabulary_path, end_id, id_col, text_col)
    return read_digests(spark, folder, manifest).withColumnRenamed("id", id_col)
