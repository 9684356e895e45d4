"""Mixing sources to target weights by hash thresholds, in DataFrame operations only.

Every document has a hash that depends on its id alone. A source's share is the set of its documents whose
hash lies below a threshold. The threshold is found from histograms: sum the sizes by source and leading hash
digit, find the bucket in which the running sum passes the budget, and histogram that bucket alone by the next
digit. No step sorts documents, and a larger budget takes a superset of what a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.names import column, columns, unused
from quern.functions.text import word_count
from quern.sources.scratch import Scratch

HASH_BITS, DIGIT_BITS = 60, 12


def unit_hash(id_col: str):
    """The first 60 bits of the id's MD5, as a non-negative long; any SQL engine can compute it."""
    text = F.coalesce(column(id_col).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from one row per source: weights repeat over the sources in order.

    target = min(most * size, level * weight), with one level for all, such that targets sum to share * all sizes:
    that is where resharing what exceeds a limit by weight ends. Sources are sorted by the level at which they
    fill up; the first that is not full at the level left by those before it gives the common level.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy("fills_at", "k")
    everything = W.partitionBy()
    ranked = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("fills_at", F.col("limit") / F.col("weight"))
    before = F.coalesce(F.sum("limit").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    # all weights less those before: a frame that ends with the last row would be summed anew for every row
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    ranked = ranked.withColumn("level", (budget - before) / rest)
    place = F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "k", "level"))
    ranked = ranked.withColumn("common", F.min(place).over(everything)["level"])
    target = F.coalesce(F.least("limit", F.col("common") * F.col("weight")), F.col("limit"))
    return ranked.select("source", "source_size", target.alias("target"))


def _thresholds(slim: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, whole, last): documents with hash <= last are taken once more than whole times.

    The document at the boundary is taken if that brings the source nearer to its target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = targets.withColumn("whole", whole)
    start = start.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    start = scratch.table(start)
    open_ = start.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    found = None
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        one = F.col("s.source").eqNullSafe(F.col("o.source"))
        inside = slim.alias("s").join(
            open_.alias("o"), one & (F.shiftright("s.hash", shift + DIGIT_BITS) == F.col("o.prefix"))
        )
        buckets = inside.groupBy("o.source", "o.budget", "o.below", F.shiftright("s.hash", shift).alias("digit")).agg(
            F.sum("s.size").alias("in_bucket"), F.min("s.hash").alias("first"), F.max("s.hash").alias("final")
        )
        up_to = W.partitionBy("source", "budget", "below").orderBy("digit")
        run = buckets.withColumn("upto", F.col("below") + F.sum("in_bucket").over(up_to))
        edge = (
            run.filter("upto > budget")
            .groupBy("source", "budget")
            .agg(F.min(F.struct("digit", "upto", "in_bucket", "first", "final")).alias("e"))
        )
        edge = scratch.table(edge.select("source", "budget", "e.*", (F.col("e.upto") - F.col("e.in_bucket")).alias("under")))
        nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("under"))
        settled = edge.filter("first = final").select("source", F.when(nearer, F.col("final")).otherwise(F.col("first") - 1).alias("last"))
        found = settled if found is None else found.unionByName(settled)
        open_ = edge.filter("first < final").select("source", "budget", F.col("digit").alias("prefix"), F.col("under").alias("below"))
        if open_.limit(1).count() == 0:
            break
    joined = start.alias("a").join(found.alias("f"), F.col("a.source").eqNullSafe(F.col("f.source")), "left")
    # a source without a budget takes nothing more, not even documents without words
    last = F.when(F.col("a.budget") > 0, F.coalesce("f.last", F.lit(-1))).otherwise(F.lit(-1)).cast("long")
    return scratch.table(joined.select("a.source", "source_size", "target", "whole", last.alias("last")))


def _cut(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share, most) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "mix")
    source = column(source_col).cast("string").alias("source")
    slim = docs.select(column(id_col).alias("id"), source, word_count(column(text_col)).alias("size"), unit_hash(id_col).alias("hash"))
    slim = scratch.table(slim)
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    return slim, _thresholds(slim, source_targets(sizes, weights, share, most), scratch)


def mix_table(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, copies, taken.

    size is the number of white-space separated words (null text: 0). Sources, in code point order with null
    last, get the weights in turn; ``share`` of all words is dealt out, at most ``most`` times a source's words.
    A source's taken words differ from its target by at most half of one document's words (of all documents of
    one id, if ids repeat: they share a hash and are taken alike). A null id hashes like the text "null". Sources
    of size 0 take nothing. Of a text only its number of words is kept, however long it is. An empty table gives no rows.
    Other columns are not read. One row per source is sorted
    in one task; one row per document never is.
    """
    slim, cut = _cut(docs, id_col, text_col, source_col, weights, share, most)
    rows = slim.alias("s").join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")))
    copies = F.col("whole") + (F.col("hash") <= F.col("last")).cast("long")
    rows = rows.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"))
    return rows.withColumn("taken", F.col("size") * F.col("copies"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """docs with each row as often as ``mix_table`` takes it (0, 1, 2... times); columns as they were, whatever their
    names.

    A document is compared with its source's threshold where it stands: texts are not shuffled unless the
    thresholds, one row per source, outgrow a broadcast. Documents without words follow the threshold like any other.
    Null texts, ids and sources, repeated rows, very long texts and empty tables as in ``mix_table``.
    """
    _, cut = _cut(docs, id_col, text_col, source_col, weights, share, most)
    source, whole, last, copies, copy = unused(docs.columns, "source", "whole", "last", "copies", "copy")
    cut = cut.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("last").alias(last))
    rows = docs.join(cut, column(source_col).cast("string").eqNullSafe(F.col(source)))
    rows = rows.withColumn(copies, F.col(whole) + (unit_hash(id_col) <= F.col(last)).cast("long")).filter(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns(docs))
