"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within r bits of each other have a common point at most r/2 bits from both. So every distinct
fingerprint emits all points of the ball of half the radius around it, points meet in one shuffle, and
fingerprints that share a point are neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quern.functions.names import column, columns, unused
from quern.llm.components import connected_components
from quern.llm.hashing import column_bytes, slices, xxh64_slices
from quern.sources.scratch import Scratch

BITS = 64
#: Each byte value as eight byte-wide counters, bit 0 in the lowest.
_SPREAD = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)
#: Shingles hashed at a time, so that a very long text needs no more memory than its own bytes.
_STEP = 1 << 18


def _count_bits(h: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> None:
    """Adds to counts[d, b] how many of document d's hashes have bit b; doc is sorted."""
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sizes = np.diff(np.append(starts, len(doc)))
    blocks = np.repeat(starts, -(-sizes // 255))  # at most 255 hashes go into a byte-wide counter
    first = np.r_[True, blocks[1:] != blocks[:-1]]
    rank = np.arange(len(blocks)) - np.maximum.accumulate(np.where(first, np.arange(len(blocks)), 0))
    blocks = blocks + 255 * rank
    owner = doc[blocks]
    for k in range(8):
        lanes = _SPREAD[(h >> np.uint64(8 * k)).astype(np.uint8)]
        sums = np.add.reduceat(lanes, blocks).view(np.uint8).reshape(-1, 8)
        np.add.at(counts[:, 8 * k : 8 * k + 8], owner, sums)


def fingerprints(texts: bytes, offsets: list[int], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text in a buffer: bit set if it is set in over half of the shingles' XXH64.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; fewer words than a shingle make one
    shingle; no words make fingerprint 0.
    """
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b in slices(offsets):
        joined = [b" ".join(texts[s:e].lower().split()) for s, e in zip(offsets[a:b], offsets[a + 1 : b + 1])]
        data = b" ".join(joined)
        lengths = np.array([len(x) for x in joined])
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        # word starts and ends in data, and the document of each word
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        filled = np.flatnonzero(lengths)
        inner = gaps[~np.isin(gaps, (begin + lengths))] if len(gaps) else gaps
        starts = np.sort(np.concatenate([begin[filled], inner + 1]))
        ends = np.sort(np.concatenate([(begin + lengths)[filled], inner]))
        doc = np.searchsorted(begin[filled], starts, "right") - 1
        first_word = np.searchsorted(starts, begin[filled])
        words = np.diff(np.append(first_word, len(starts)))
        # shingle i of a document spans words i .. i + shingle - 1, clipped to its last word
        counts_of = np.maximum(words - shingle + 1, 1)
        total = int(counts_of.sum())
        own = np.repeat(np.arange(len(filled)), counts_of)
        nth = np.arange(total) - np.repeat(np.cumsum(counts_of) - counts_of, counts_of)
        head = first_word[own] + nth
        tail = np.minimum(head + shingle, (first_word + words)[own]) - 1
        counts = np.zeros((len(filled), BITS), np.int64)
        for i in range(0, total, _STEP):
            j = min(i + _STEP, total)
            at = starts[head[i:j]]
            _count_bits(xxh64_slices(data, at, ends[tail[i:j]] - at, seed), own[i:j], counts)
        bits = counts * 2 > counts_of[:, None]
        packed = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        out[a:b][filled] = packed
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp as a signed long; one row per row of docs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = fingerprints(*column_bytes(batch.column(1)), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(run, schema)


def neighbours(points: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst) among distinct fingerprints ``fp``: edges that connect all pairs within radius bits.

    Members of a point's group are all within the radius of each other, and at most 1 + 64 (for radius 2 or 3)
    distinct fingerprints can share a point, so linking each member to the one before it in the sorted group
    connects the group without listing its pairs; the distance is verified all the same.
    """
    if radius // 2 > 1:
        raise ValueError("radius 4 and more needs balls of radius 2")
    ball = [F.col("fp")]
    if radius >= 2:
        ball.append(F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))"))
        ball = [F.concat(F.array("fp"), ball[1])]
    else:
        ball = [F.array("fp")]
    spread = points.select("fp", F.explode(ball[0]).alias("point"))
    before = F.lag("fp").over(W.partitionBy("point").orderBy("fp"))
    linked = spread.select("fp", before.alias("other")).filter("other is not null")
    linked = linked.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    return linked.select(F.col("fp").alias("src"), F.col("other").alias("dst")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3
) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id, fp.

    component_id is the smallest id reachable over fingerprints that differ in at most radius bits. Null and empty
    texts have fingerprint 0 and are linked like any other. Equal fingerprints, however many, become one point
    before anything is compared. A null id counts only where its whole component has no other: component_id is
    then null. Texts are read whole; a very long one takes about ten times its size in a worker. Repeated rows give
    repeated results. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(with_fingerprint(docs, id_col, text_col, shingle))
    points = scratch.table(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = scratch.table(connected_components(neighbours(points, radius)))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    out = rows.join(classes, "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id", "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component: the one whose id names it. Columns as they were, whatever their names.

    ids must be unique for that; rows that repeat an id are kept or dropped together, and so are rows without one.
    Null, empty and very long texts and empty tables as in ``near_duplicates``.
    """
    groups = near_duplicates(docs, id_col, text_col, **options)
    (keep,) = unused(docs.columns, "keep")
    kept = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(keep)).distinct()
    return docs.join(kept, column(id_col).eqNullSafe(F.col(keep)), "left_semi").select(*columns(docs))
