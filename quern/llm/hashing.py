"""Hashing of many byte ranges at once: XXH64 over slices of one buffer, with numpy."""

from __future__ import annotations

import numpy as np

# Fixed values of the published XXH64 algorithm.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _of_length(buf: np.ndarray, at: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    """Hashes of buf[a : a + size] for every a in at."""
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    with np.errstate(over="ignore"):
        p = 0
        if size >= 32:
            v = [np.full(len(at), seed + x, np.uint64) for x in (P1 + P2, P2, np.uint64(0), np.uint64(0) - P1)]
            while p + 32 <= size:
                for k in range(4):
                    v[k] = _round(v[k], wide[at + (p + 8 * k)])
                p += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            zero = np.zeros(len(at), np.uint64)
            for lane in v:
                h = (h ^ _round(zero, lane)) * P1 + P4
        else:
            h = np.full(len(at), seed + P5, np.uint64)
        h = h + np.uint64(size)
        while p + 8 <= size:
            h = _rotl(h ^ _rotl(wide[at + p] * P2, 31) * P1, 27) * P1 + P4
            p += 8
        if p + 4 <= size:
            four = wide[at + p] & np.uint64(0xFFFFFFFF)
            h = _rotl(h ^ four * P1, 23) * P2 + P3
            p += 4
        while p < size:
            h = _rotl(h ^ buf[at + p].astype(np.uint64) * P5, 11) * P1
            p += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def xxh64_slices(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of data[s : s + n] for all (s, n), grouped by length so that each step works on whole arrays.

    Ranges longer than 256 bytes, which would make many groups of few, are hashed one by one.
    """
    import xxhash

    buf = np.frombuffer(data + b"\0" * 8, np.uint8)
    out = np.empty(len(starts), np.uint64)
    kinds = np.minimum(lengths, 257).astype(np.uint16)  # a stable sort of 16-bit numbers is a radix sort
    order = np.argsort(kinds, kind="stable")
    ends = np.cumsum(np.bincount(kinds, minlength=258))
    for size in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        pick = order[ends[size - 1] if size else 0 : ends[size]]
        if size <= 256:
            out[pick] = _of_length(buf, starts[pick], size, np.uint64(seed))
        else:
            out[pick] = [xxhash.xxh64_intdigest(data[s : s + n], seed) for s, n in zip(starts[pick].tolist(), lengths[pick].tolist())]
    return out


def distinct_slices(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one range of each distinct content, and for each range the number of its content among those.

    Ranges are sorted by hash; a second hash and the lengths must agree wherever the first does, else the bytes
    themselves are compared.
    """
    h = xxh64_slices(data, starts, lengths)
    by_hash = np.argsort(h)
    ordered = h[by_hash]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(h)]
    group = np.cumsum(new) - 1
    chosen, own = by_hash[new], np.empty(len(h), np.int64)
    own[by_hash] = group
    check = xxh64_slices(data, starts, lengths, seed=1)
    if not (np.array_equal(check, check[chosen][own]) and np.array_equal(lengths, lengths[chosen][own])):
        seen: dict[bytes, int] = {}
        pieces = [data[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist())]
        own = np.array([seen.setdefault(x, len(seen)) for x in pieces])
        chosen = np.unique(own, return_index=True)[1]
    return chosen, own


def column_bytes(column) -> tuple[bytes, list[int]]:
    """An Arrow string array as one UTF-8 buffer and the offsets of its values; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    offsets = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
    data = filled.buffers()[2]
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None and len(filled) else b""
    return raw, (offsets - offsets[0]).tolist()


def slices(offsets: list[int], at_least: int = 1 << 20):
    """Ranges of rows whose values hold about at_least bytes together (one longer value stands alone)."""
    start = 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[start] >= at_least or i == len(offsets) - 1:
            yield start, i
            start = i
