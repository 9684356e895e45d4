import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from quern.llm.bpe import EditableText, Pieces, PrefixTable, Vocabulary, decode_bytes, encode, encode_digests, encoded
from quern.llm.hashing import column_bytes
from tests.llm.cases import frame, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LETTERS = "a b  c'sdtrevml \n\t\r\x0b  é1２٣²½中文!?.\"''<|>\x1c\x85　😀‍́"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.from_file(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(r, most=30):
    return "".join(r.choice(LETTERS) for _ in range(r.randrange(most)))


def test_same_ids_as_the_library(vocabulary, library):
    r = random.Random(2)
    texts = [x[1] or "" for x in odd_documents()] + [random_text(r) for _ in range(1500)]
    texts += ["", "'s", "''s", " 's", "a's b'sx  '", "x'LL 'll 'llm", "  \n  a", " \n", "a  ", "'", "<|endoftext|>", "  x"]
    texts.append("long " * 300_000 + "x" * 3000)
    for memo in (Pieces(vocabulary), Pieces(vocabulary, 1000)):
        got = [x.tolist() for x in encoded(*column_bytes(pa.array(texts)), memo)]
        assert got == [library.encode_ordinary(t) for t in texts]


def test_text_grows_and_changes_as_if_encoded_anew(vocabulary, library):
    r = random.Random(4)
    for _ in range(150):
        text = random_text(r)
        kept = EditableText(vocabulary, public_tokenizers.PATTERN, text)
        for _ in range(4):
            a = r.randrange(len(text) + 1)
            b, new = r.randrange(a, len(text) + 1), random_text(r, 6)
            text = text[:a] + new + text[b:]
            kept.replace(a, b, new)
            assert kept.ids() == library.encode_ordinary(text)
        kept.append("'re")
        assert kept.ids() == library.encode_ordinary(text + "'re")


def test_an_edit_is_recomputed_near_its_place(vocabulary):
    data = bytes(random.Random(5).choice(b"thea nd") for _ in range(3000))
    table = PrefixTable(vocabulary, data)
    computed = table.replace(500, 505, b"xyz")
    assert table.ids() == PrefixTable(vocabulary, data[:500] + b"xyz" + data[505:]).ids()
    assert computed < 1000


def test_round_trip_and_digests(spark, vocabulary, library):
    rows = odd_documents()
    ids = Counter((r["doc_id"], tuple(r["ids"])) for r in encode(frame(spark), PATH).collect())
    assert ids == Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t, *_ in rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        own = library.encode_ordinary(t or "")
        assert decode_bytes(own, vocabulary) == (t or "").encode()
        want[i, len(own), sha(" ".join(map(str, own)).encode()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, encode_digests(frame(spark), PATH).collect())) == want
    assert encode_digests(frame(spark, []), PATH).collect() == []


def test_pieces_are_told_apart_when_hashes_clash(monkeypatch):
    from quern.llm import hashing

    data, starts, lengths = b"abcabcxabd", np.array([0, 3, 6, 7]), np.array([3, 3, 1, 3])
    monkeypatch.setattr(hashing, "xxh64_slices", lambda d, s, n, seed=0: np.zeros(len(s), np.uint64) if seed == 0 else s.astype(np.uint64))
    chosen, own = hashing.distinct_slices(data, starts, lengths)
    assert [data[s : s + n] for s, n in zip(starts[chosen][own], lengths[chosen][own])] == [b"abc", b"abc", b"x", b"abd"]
