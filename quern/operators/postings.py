"""A written full-text index: exact BM25 top k without reading a text, and updates without a rewrite.

Layout, in Parquet under one folder: ``postings`` by generation and bucket of the term, sorted by term; a row holds the postings of
one block, that is of a term, project, visibility and slice, with the largest term count and the smallest record
length in it. A slice is a group of records of similar length that all terms share. ``docs`` has each record's length,
``replaced`` the records that a generation takes from those before it, ``stats`` one row a generation, written last:
a generation without it does not exist, so a writer that was lost leaves nothing that is read.

A query reads the blocks of its terms' buckets only. From their maxima follows the best score that a slice could hold; some
slices of the highest bounds give a score that k records reach, and only slices whose bound is not below it are opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.stemming import term_counts
from quern.functions.text import lower_tokens
from quern.sources.scratch import Scratch

K1, B = 1.2, 0.75
#: Records to a bucket of terms, and buckets at least; records of a slice, about, if all have one length; slices that are opened to
#: find a score to beat.
BUCKET, BUCKETS, BLOCK, FIRST = 1 << 16, 4, 1 << 15, 8
#: Ways that a bucket is dealt out in, at least; tokens whose postings are sorted in one task, about.
DEALT, PART_TOKENS = 16, 1 << 21
#: Scores are rounded to six places, so a bound may be short of a score by half of one.
ROUNDED = 1e-6

DOCS = "project string, key string, dl int, gen int"
REPLACED = "project string, key string, gen int"
STATS = "n long, total long, slices int, buckets int, gen int"
POSTINGS = (
    "term string, project string, visible boolean, slice long, max_tf long, min_dl int, n long, "
    "postings array<struct<key: string, created_at: timestamp_ntz, tf: long, dl: int>>, gen int, bucket int"
)


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def is_visible() -> Column:
    """Of a record: not a ledger entry (tag roi); records without tags are visible."""
    return ~F.coalesce(F.array_contains("tags", "roi"), F.lit(False))


#: A task's part of some slices of a term, as arrays side by side; counts are tf in the upper and dl in the lower 32 bits. Those
#: without a term hold all records.
PARTS = "term string, project string, visible boolean, hashed long, key array<string>, created_at array<timestamp_ntz>, counts array<long>"


def block_parts(memory: DataFrame, slices: int) -> DataFrame:
    """Parts of the blocks of records, one record for each project and key: records are counted and packed where they stand, so what
    is shuffled afterwards are postings by term and not words."""
    hashed = F.pmod(F.xxhash64("project", "key"), F.lit(slices))
    rows = memory.select("project", is_visible().alias("visible"), hashed.alias("hashed"), "key", "created_at", lower_tokens(F.col("content")).alias("tokens"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, terms, row, term, tf in term_counts(batches, "tokens"):
            dl = np.diff(batch.column("tokens").offsets.to_numpy()).astype(np.int32)
            groups: dict[tuple, int] = {}
            heads = zip(*(batch.column(c).to_pylist() for c in ("project", "visible", "hashed")))
            group = np.array([groups.setdefault(h, len(groups)) for h in heads], np.int64)
            # all records under one more term, which is none
            row, term = np.r_[row, np.arange(len(batch))], np.r_[term, np.full(len(batch), len(terms))]
            tf = np.r_[tf, np.zeros(len(batch), np.int64)].astype(np.int32)
            block = term * len(groups) + group[row]
            order = np.argsort(block, kind="stable")
            row, tf, block = row[order], tf[order], block[order]
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            cuts = pa.array(np.r_[starts, len(block)].astype(np.int32))
            of = pa.array(block[starts] // len(groups))
            head = [list(groups)[g] for g in (block[starts] % len(groups)).tolist()]
            lists = [batch.column("key").take(pa.array(row)), batch.column("created_at").take(pa.array(row)), pa.array(tf.astype(np.int64) << 32 | dl[row])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*terms, None], pa.string()).take(of), *(pa.array([h[i] for h in head], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64()))),
                 *(pa.ListArray.from_arrays(cuts, x) for x in lists)], [c.split()[0] for c in PARTS.split(", ")],
            )

    return rows.select("project", "visible", "hashed", "key", "created_at", "tokens").mapInArrow(run, PARTS)


def _listed(parts: DataFrame) -> DataFrame:
    """(project, key, dl) of all records."""
    all_ = parts.filter("term is null").select("project", F.inline(F.arrays_zip("key", "counts")))
    return all_.select("project", "key", F.col("counts").bitwiseAND(0xFFFFFFFF).cast("int").alias("dl"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@dataclass
class Statistics:
    """Over all records, visible or not: their number, mean length, and how many hold each term."""

    n: int
    avgdl: float | None
    df: list[int]


@dataclass
class Postings:
    """The index in a folder. One writer at a time; readers see whole generations only, as of their first look or ``refresh``."""

    spark: SparkSession
    root: str
    _seen: list | None = None

    def _read(self, name: str, schema: str) -> DataFrame:
        gens = [g.gen for g in self.generations()]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").filter(F.col("gen").isin(gens))

    def exists(self) -> bool:
        return _exists(self.spark, f"{self.root}/stats")

    def generations(self) -> list:
        """The rows of stats: one for each generation, few between two builds."""
        if self._seen is None:
            self._seen = self.spark.read.schema(STATS).parquet(f"{self.root}/stats").collect() if self.exists() else []
        return self._seen

    def refresh(self) -> Postings:
        self._seen = None
        return self

    def build(self, memory: DataFrame, buckets: int | None = None, block: int = BLOCK) -> Postings:
        """Indexes records (key, content, tags, project, created_at), one for each project and key, as generation 0."""
        if self.generations():
            raise ValueError("the folder holds an index already")
        n = memory.count()
        scratch = Scratch(self.spark, "postings")
        parts = scratch.table(block_parts(memory, n // block + 1))
        self._write(parts, 0, n // block + 1, buckets or max(BUCKETS, n // BUCKET), None)
        scratch.drop(parts)
        return self.refresh()

    def add(self, records: DataFrame) -> Postings:
        """Stores records, each in place of one of its project and key: a new generation, whatever is older stays as it is."""
        gens = self.generations()
        scratch = Scratch(self.spark, "postings")
        parts = scratch.table(block_parts(records, gens[0].slices))
        self._write(parts, max(g.gen for g in gens) + 1, gens[0].slices, gens[0].buckets, _listed(parts).select("project", "key").distinct())
        scratch.drop(parts)
        return self.refresh()

    def remove(self, keys: DataFrame) -> Postings:
        """Takes the records (project, key) out of the index."""
        gens = self.generations()
        none = self.spark.createDataFrame([], PARTS)
        self._write(none, max(g.gen for g in gens) + 1, gens[0].slices, gens[0].buckets, keys.select("project", "key").distinct())
        return self.refresh()

    def _write(self, parts: DataFrame, gen: int, slices: int, buckets: int, touched: DataFrame | None) -> None:
        at = lambda name: f"{self.root}/{name}/gen={gen}"
        _listed(parts).write.mode("overwrite").parquet(at("docs"))
        docs = self.spark.read.schema(DOCS).parquet(f"{self.root}/docs").filter(F.col("gen") == gen)
        n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if touched is not None:
            old = self._live(self._read("docs", DOCS)).join(touched, ["project", "key"], "left_semi")
            old.select("project", "key").write.mode("overwrite").parquet(at("replaced"))
            gone = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, total = n - gone[0], total - gone[1]
        # one shuffle: a bucket is dealt out by term and records' hash, as a frequent term has postings of all records
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), total // PART_TOKENS + 1)
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        dealt = F.pmod(F.xxhash64("term", "hashed"), F.lit(max(DEALT, 4 * tasks // buckets)))
        own = parts.filter("term is not null").select("*", bucket.alias("bucket"), dealt.alias("dealt")).repartition(tasks, "bucket", "dealt")
        own = own.select("bucket", "dealt", "term", "project", "visible", "hashed", F.inline(F.arrays_zip("key", "created_at", "counts")))
        own = own.withColumns({"tf": F.shiftright("counts", 32), "dl": F.col("counts").bitwiseAND(0xFFFFFFFF).cast("int")})
        # the square root of two from one class of lengths to the next
        length = F.floor(2 * F.log2(F.col("dl") + 1)).cast("long")
        own = own.withColumn("slice", F.shiftleft(length, 32) + F.col("hashed"))
        blocks = own.groupBy("bucket", "dealt", "term", "project", "visible", "slice").agg(
            F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("key", "created_at", "tf", "dl")).alias("postings")
        ).drop("dealt")
        blocks.sortWithinPartitions("bucket", "term", "slice").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        stats = self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total).cast("long").alias("total"), F.lit(slices).alias("slices"), F.lit(buckets).alias("buckets"))
        stats.coalesce(1).write.mode("overwrite").parquet(at("stats"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (project, key, gen, ...) without those that a later generation replaces."""
        if len(self.generations()) < 2:
            return rows
        gone = self._read("replaced", REPLACED).select(F.col("project").alias("__p"), F.col("key").alias("__k"), F.col("gen").alias("__g"))
        same = F.col("project").eqNullSafe(F.col("__p")) & F.col("key").eqNullSafe(F.col("__k")) & (F.col("__g") > F.col("gen"))
        return rows.join(gone, same, "left_anti")

    def blocks(self, terms: Sequence[str]) -> DataFrame:
        """Blocks of the terms: partitions of their buckets, and of those the rows that Parquet's filter leaves."""
        gens = self.generations()
        if not terms or not gens:
            return self.spark.createDataFrame([], POSTINGS)
        bucket = lambda t: F.pmod(F.xxhash64(F.lit(t)), F.lit(gens[0].buckets)).cast("int")  # noqa: E731  folded before the scan
        own = reduce(Column.__or__, [F.col("bucket") == bucket(t) for t in terms])
        return self._read("postings", POSTINGS).filter(own & F.col("term").isin(list(terms)))

    def postings(self, blocks: DataFrame) -> DataFrame:
        """(gen, term, project, slice, key, created_at, tf, dl) of blocks, without replaced records."""
        rows = blocks.select("gen", "term", "project", "slice", F.inline("postings"))
        return self._live(rows)

    def statistics(self, terms: Sequence[str]) -> Statistics:
        """Numbers of one query: read from stats and from the heads of its terms' blocks."""
        gens, blocks = self.generations(), self.blocks(terms)
        n, total = sum(g.n for g in gens), sum(g.total for g in gens)
        held = blocks if len(gens) < 2 else self.postings(blocks).withColumn("n", F.lit(1))
        df = {r.term: r.df for r in held.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        return Statistics(n, total / n if n else None, [df.get(t, 0) for t in terms])

    def _bounds(self, shown: DataFrame, terms: Sequence[str], score: list) -> DataFrame:
        """(slice, bound) of slices that hold every term: no record of the slice scores higher."""
        most = [F.max(F.when(F.col("term") == t, F.col("max_tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
        least = [F.min(F.when(F.col("term") == t, F.col("min_dl"))).alias(f"dl{i}") for i, t in enumerate(terms)]
        heads = shown.groupBy("slice").agg(*most, *least).dropna()
        return heads.select("slice", sum((s(F.col(f"tf{i}"), F.col(f"dl{i}")) for i, s in enumerate(score)), F.lit(0.0)).alias("bound"))

    def _hits(self, shown: DataFrame, terms: Sequence[str], score: list) -> DataFrame:
        """(key, created_at, score) of records that hold every term."""
        tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
        rows = self.postings(shown).groupBy("key", "created_at", "dl").agg(*tf).dropna(subset=[f"tf{i}" for i in range(len(terms))])
        parts = [s(F.col(f"tf{i}"), F.col("dl")) for i, s in enumerate(score)]
        return rows.select("key", "created_at", F.round(sum(parts[1:], parts[0]), 6).alias("score"))

    def slices_to_open(self, shown: DataFrame, terms: Sequence[str], score: list, k: int) -> DataFrame:
        """Slices whose bound reaches the k-th best score in some slices with the highest bounds (k of them, or FIRST)."""
        bounds = self._bounds(shown, terms, score)
        first = [r.slice for r in bounds.orderBy(F.col("bound").desc(), "slice").limit(max(FIRST, k)).collect()]
        best = self._hits(shown.filter(F.col("slice").isin(first)), terms, score).select("score").orderBy(F.col("score").desc()).limit(k).collect()
        beat = best[-1].score - ROUNDED if len(best) == k else float("-inf")
        return bounds.filter(F.col("bound") >= beat).select("slice")

    def top(self, project: str, terms: Sequence[str], k: int, *tie: Column) -> DataFrame:
        """(key, created_at, score): the k best visible records of the project that hold every term, by score, tie, key.

        The same rows as ranking all records. No term finds nothing. What comes to the driver is a score for each of k records, and the
        statistics of the query's terms.
        """
        order = [F.col("score").desc(), *tie, "key"]
        stats = self.statistics(terms)
        shown = self.blocks(terms).filter((F.col("project") == project) & F.col("visible"))
        if not terms or not all(stats.df):
            return self.spark.createDataFrame([], "key string, created_at timestamp_ntz, score double")
        score = [lambda tf, dl, df=df: bm25(tf, dl, F.lit(df), F.lit(stats.n), F.lit(stats.avgdl)) for df in stats.df]
        opened = self.slices_to_open(shown, terms, score, k)
        return self._hits(shown.join(opened, "slice", "left_semi"), terms, score).orderBy(*order).limit(k)
