"""How quality filters interact: what each step of every order of the filters removes, from counts of one pass.

A document's failures are a mask of one bit per filter. Documents are counted by part and mask; the subset-zeta
transform turns a part's 2^n mask counts into f[T], the documents whose failures all lie in T, for every T. What survives a set
S of filters is f of the other filters, so each step of each order is a difference between two neighbouring subsets,
and the same holds for labelled documents. No order is ever run over the documents.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.names import column
from quern.functions.text import WORD
from quern.sources.scratch import Scratch

#: Failure conditions of a text ``t`` with its words ``w``, by filter; DUPLICATE stands for equality with an earlier text.
FAILS = {
    "A": "size(w) < 50",
    "B": "100L * size(array_distinct(w)) < 65L * size(w)",
    "C": "100L * regexp_count(t, '[A-Z]') > 5L * length(t)",
    "D": "t rlike '[#$%&*|]'",
}
DUPLICATE = "E"


def failure_masks(docs: DataFrame, id_col: str, text_col: str, part_col: str, fails: Mapping[str, str] = FAILS, duplicate: str = DUPLICATE) -> DataFrame:
    """(id, part, mask, digest): bit i of mask is set if the text fails the i-th filter by name; the bit of ``duplicate``
    is set where a smaller id has the same text.

    One pass over the texts, in the JVM, writes a narrow table; texts meet by their SHA-256. Of each digest the smallest
    id is combined before its shuffle, and only digests of several rows are joined back, by a join that can be split.
    """
    names = sorted([*fails, duplicate])
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("id"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), 0))
    own = sum((F.when(F.expr(f), 1 << names.index(n)).otherwise(0) for n, f in fails.items()), F.lit(0))
    scratch = Scratch(docs.sparkSession, "filters")
    rows = scratch.table(rows.select("id", "part", own.cast("int").alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest")))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    again = F.when(F.col("id") > F.col("first"), 1 << names.index(duplicate)).otherwise(0)
    return rows.join(firsts, "digest", "left").select("id", "part", (F.col("mask") + again).alias("mask"))


def _zeta(counts: Column, bits: int) -> Column:
    """f[T] = sum of counts[M] over the subsets M of T, one bit at a time."""
    step = lambda f, b: F.transform(f, lambda x, i: x + F.when(i.bitwiseAND(b) != 0, F.get(f, i - b)).otherwise(0))
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits)]), counts, step)


def interactions(masks: DataFrame, filters: str) -> DataFrame:
    """For every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    masks: (part, mask, good, toxic), bit i for filters[i]. One row per part, its mask counts in arrays of 2^n, is all that is expanded.
    """
    n, full = len(filters), (1 << len(filters)) - 1
    counted = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )
    # a part has 2^n masks at most
    parts = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("docs", "good", "toxic")))).alias("by"))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.try_element_at("by", m)[c], F.lit(0).cast("long")))
    parts = parts.select("part", *(_zeta(dense(c), n).alias(f"f_{c}") for c in ("docs", "good", "toxic")))
    orders = ",".join(map("".join, itertools.permutations(filters)))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letters = F.split("filter_order", "")
    bit = lambda letter: F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)]), letter)
    before = F.aggregate(F.slice(letters, 1, F.col("step") - 1), F.lit(0), lambda m, x: m + bit(x))
    steps = steps.withColumn("before", before).withColumn("bit", bit(F.element_at(letters, F.col("step"))))
    left = lambda c, s: F.get(f"f_{c}", F.lit(full) - s)  # noqa: E731  what survives the filters of a set
    lost = lambda c, s: left(c, s) - left(c, s + F.col("bit"))
    # removed by the filter after a set of others, times the orders that put just those before it
    sizes = [math.factorial(bin(s).count("1")) * math.factorial(max(0, n - 1 - bin(s).count("1"))) for s in range(full + 1)]
    ways = F.array(*map(F.lit, sizes))
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"),
        lambda total, s: total + F.when(s.bitwiseAND(F.col("bit")) == 0, F.get(ways, s) * lost("docs", s)).otherwise(0),
    )
    removed, none = lost("docs", F.col("before")), F.lit(0)
    return steps.select(
        "part", "filter_order", "step", left("docs", F.col("before") + F.col("bit")).alias("kept"), removed.alias("removed"),
        (lost("docs", none) - removed).alias("redundant"), (F.get("f_docs", F.col("bit")) - F.get("f_docs", none)).alias("unique_fails"),
        lost("good", F.col("before")).alias("good_lost"), lost("toxic", F.col("before")).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", fails: Mapping[str, str] = FAILS, duplicate: str = DUPLICATE
) -> DataFrame:
    """``interactions`` of the filters over docs by part, with labels (id_col, quality, toxic): one row per part, order and step.

    Null texts count as empty, which are equal to each other; a null part is the empty string. A null id is no smaller
    id and has none. Rows that repeat an id count each, share its labels and do not make each other duplicates.
    An id with several labels is good (toxic) if any of them is 1; null labels are none. Texts are read whole, a very
    long one takes some ten times its size; a part, text or label may hold any share of the rows. No documents
    give no rows; columns by other names are not read.
    """
    masks = failure_masks(docs, id_col, text_col, part_col, fails, duplicate)
    is_one = lambda c: F.coalesce(F.max(column(c) == 1), F.lit(False))
    known = labels.filter(column(id_col).isNotNull()).groupBy(column(id_col).alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    masks = masks.join(known, "id", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return interactions(masks, "".join(sorted([*fails, duplicate])))
