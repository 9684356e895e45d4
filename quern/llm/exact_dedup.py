"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into fixed-size blocks. All distinct blocks are sorted into integer names; then adjacent
names are paired, the distinct pairs sorted into names of the next level, and so on, until every document
has one name. Equal (level, name) means equal text: no step trusts a hash (see ``_level_zero``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.names import column, columns, unused
from quern.functions.text import ascii_lower
from quern.sources.scratch import Scratch

BLOCK_BYTES = 4096
#: Names are sorted inside 2**16 buckets of the key's hash, so no sort is larger than its bucket.
BUCKET_BITS = 16


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``name``: the rank of its keys among the distinct keys of their bucket, after the bucket number.

    Frequent keys are combined before the shuffle (distinct), and the join that carries names back can be
    split by adaptive execution, so a key that a third of all rows holds stays spread.
    """
    distinct = rows.select(*keys).distinct()
    bucket = F.shiftrightunsigned(F.xxhash64(*keys), 64 - BUCKET_BITS)
    place = W.partitionBy("bucket").orderBy(*keys)
    names = distinct.withColumn("bucket", bucket).select(
        *keys, (F.shiftleft(F.col("bucket"), 64 - BUCKET_BITS - 8) + F.row_number().over(place)).alias("name")
    )
    return rows.join(names, keys)


def _level_zero(texts: DataFrame, scratch: Scratch, block_bytes: int, hash_bits: int) -> tuple[DataFrame, list[str]]:
    """One row per distinct document and block, and the columns that identify the block.

    Blocks travel to each other once, to count the distinct blocks of each hash. Only if every hash stands for
    one block does the hash replace the block as its key; if any two blocks share one, the key is the pair of
    hash and block itself. Both keys are exact.
    """
    n = F.greatest(F.ceil(F.octet_length("t") / block_bytes), F.lit(1)).cast("int")
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(b, i * {block_bytes} + 1, {block_bytes}))")
    docs = texts.select("id", F.sha2("t", 256).alias("sha"), n.alias("n"), F.col("t").cast("binary").alias("b"))
    blocks = docs.select("id", "sha", "n", F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.withColumn("h", F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits))

    per_hash = blocks.select("h", "block").distinct().groupBy("h").count()
    clash = per_hash.filter("count > 1").limit(1).count() > 0
    keys = ["h", "block"] if clash else ["h"]
    kept = blocks.groupBy("id", "sha", "n", "pos", *keys).agg(F.count(F.lit(1)).alias("m"))
    return scratch.table(kept), keys


def text_identities(
    docs: DataFrame, id_col: str, text: Column, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64
) -> DataFrame:
    """(id, sha, m, level, name): one row per distinct pair of id and text, m the number of such rows."""
    scratch = Scratch(docs.sparkSession, "exact")
    texts = docs.select(column(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    rows, keys = _level_zero(texts, scratch, block_bytes, hash_bits)
    longest = rows.agg(F.max("n")).first()[0] or 1
    named = scratch.table(_named(rows, keys).select("id", "sha", "m", "n", "pos", "name"))
    scratch.drop(rows)
    done, level = [], 0
    while True:
        done.append(named.filter("n = 1").select("id", "sha", "m", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        pairs = (
            named.filter("n > 1")
            .groupBy("id", "sha", "m", "n", F.expr("pos div 2").cast("int").alias("half"))
            .agg(
                F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("left_name"),
                # names start at 1: 0 stands for a missing right neighbour
                F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(0)).alias("right_name"),
            )
            .select("id", "sha", "m", F.expr("(n + 1) div 2").cast("int").alias("n"), F.col("half").alias("pos"), "left_name", "right_name")
        )
        named = scratch.table(_named(pairs, ["left_name", "right_name"]).select("id", "sha", "m", "n", "pos", "name"))
        longest, level = (longest + 1) // 2, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64
) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The row with the
    largest id stays. Rows that repeat both id and text get one row each, and one of them is kept. A null id
    is smaller than every other. An empty table gives no rows. Only id_col and text_col are read, so further
    columns, whatever their names, do no harm. A very long text is cut into blocks, so no step needs more memory for it
    than its own size. hash_bits below 64 forces clashes, for tests.
    """
    ids = text_identities(docs, id_col, ascii_lower(column(text_col)), block_bytes, hash_bits)
    groups = ids.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("m").alias("group_size"))
    # as a table of its own it meets ids in a plain shuffle join, whose large groups adaptive execution can split
    groups = Scratch(docs.sparkSession, "exact").table(groups)
    rows = ids.join(groups, ["level", "name"])
    return rows.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("copy"), F.col("sha").alias("text_sha256")
    ).select(
        id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that ``exact_duplicates`` does not keep; columns as they were, whatever their names.

    The rows to drop are found by id and text hash. Of rows that repeat both the one whose columns come first as JSON
    stays. Nulls, very long texts and empty tables as in ``exact_duplicates``.
    """
    verdict = exact_duplicates(docs, id_col, text_col)
    own_id, own_sha, sha, row, group = unused(docs.columns, "id", "sha", "h", "row", "group")
    keep = verdict.filter("kept").select(column(id_col).alias(own_id), F.col("text_sha256").alias(own_sha))
    rows = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(column(text_col), F.lit(""))), 256))
    repeated = verdict.groupBy(id_col).count().filter("count > 1").limit(1).count() > 0
    if repeated:  # ids alone do not name rows: keep one row of each kept pair of id and text
        whole = F.struct(*columns(docs))
        rows = rows.groupBy(column(id_col).alias(group), sha).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*", sha)
    match = column(id_col).eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(own_sha))
    return rows.join(keep, match, "left_semi").select(*columns(docs))
