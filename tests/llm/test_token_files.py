import io
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import token_files as F
from tests.llm.cases import frame, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    library = Tokenizer.from_file(PATH)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_document_in_order(spark):
    rows = odd_documents() + [(90, "long <|endoftext|> text " * 50_000, *[None] * 8)]
    got = sorted((tuple(r) for r in F.token_digests(frame(spark, rows), PATH, 2).collect()), key=lambda r: r[1])
    assert got == want(rows)
    assert F.token_digests(frame(spark, []), PATH, 2).collect() == []


def test_manifest_and_random_access(spark, tmp_path):
    manifest = F.write_token_files(frame(spark), f"file://{tmp_path}", PATH, 2)
    assert json.loads((tmp_path / "manifest.json").read_text()) == manifest
    assert manifest["documents"] == len(odd_documents())
    (tmp_path / "tokens-000000-left.qtok").write_bytes(b"of an attempt that did not count")
    manifest = F.write_token_files(frame(spark), f"file://{tmp_path}", PATH, 2)
    assert {p.name for p in tmp_path.glob("*.qtok")} == {f["name"] for f in manifest["files"]}
    name = manifest["files"][-1]["name"]
    reader = F.FrameReader(open(tmp_path / name, "rb"), (tmp_path / name).stat().st_size)
    assert all(reader.document(i)[-1] == 2 for i in range(len(reader)))


def test_a_reader_decompresses_only_what_it_is_asked_for(monkeypatch):
    monkeypatch.setattr(F, "FRAME_IDS", 10)
    stream = io.BytesIO()
    writer = F.FrameWriter(stream, 4)
    docs = [np.arange(n, dtype=np.uint32) + 70_000 for n in (3, 0, 9, 30, 1)]
    for k, d in enumerate(docs):
        writer.add(k, d)
    writer.close()
    data = stream.getvalue()
    reader = F.FrameReader(io.BytesIO(data), len(data))
    assert len(reader.frames) == 3 and reader.keys.tolist() == [0, 1, 2, 3, 4]
    asked = []
    frame_of = reader._frame
    reader._frame = lambda *a: asked.append(a) or frame_of(*a)
    assert reader.document(3).tolist() == docs[3].tolist() and len(asked) == 1
    bad = bytearray(data)
    bad[reader.frames[0][0] + 4] ^= 1
    damaged = F.FrameReader(io.BytesIO(bytes(bad)), len(bad))
    with pytest.raises(ValueError, match="damaged"):
        damaged.document(0)
    assert damaged.document(4).tolist() == docs[4].tolist()
    with pytest.raises(ValueError):
        F.FrameReader(io.BytesIO(data[:-3]), len(data) - 3)


def test_added_tokens_in_a_text_are_the_librarys(spark):
    texts = ["end of one<|endoftext|>start", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "a <|endoftext|>\n\n b<|endoftext", None, "", " é<|endoftext|>é's"]
    library = Tokenizer.from_file(PATH)
    rows, start = [], 0
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        rows.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in F.token_digests(docs, PATH, 2).collect()) == rows


def test_added_tokens_with_rules_of_their_own(tmp_path):
    from tokenizers import AddedToken

    library = Tokenizer.from_file(PATH)
    library.add_special_tokens([AddedToken("<|x|>", lstrip=True, rstrip=True), AddedToken("<|word|>", single_word=True)])
    library.save(str(tmp_path / "t.json"))
    texts = ["a  <|x|>  b", "a<|word|>b", "a <|word|> b", "", "plain", "<|endoftext|>c"]
    data, ends = "".join(texts).encode(), np.cumsum([0] + [len(t) for t in texts]).tolist()
    got = [x.tolist() for x in F.LibraryPieces(str(tmp_path / "t.json")).ids(data, ends)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
