"""Near-duplicate vectors with a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Vectors that are close see much the same
pivots, so a vector is posted in the inverted lists of the first PREFIX of its pivots; two vectors of a list are
candidates if their whole descriptions share at least SHARED pivots, and candidates are verified with their cosine.
Candidates meet by their second shared pivot: inside a list by sublists of further pivots, and a list too long for one
task is dealt out by those pivots in the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.components import connected_components
from quern.sources.scratch import Scratch

#: Nearest pivots in a description, those of them that post a vector, and how many of all two candidates share at least.
NEAREST, PREFIX, SHARED = 8, 6, 2
#: Pivots: PIVOTS times the square root of the number of vectors, at most MAX_PIVOTS (documented bound of the fitted sample).
PIVOTS, MIN_PIVOTS, MAX_PIVOTS = 4, 64, 8192
#: Pivots with this cosine and more do for each other.
APART = 0.7
#: A list of more vectors is dealt out by second pivots; one of a pair of pivots comes in blocks of about this many.
LONG = 8192
#: Vectors compared with one product; lists of so many need no sublists. Hits of a product that are checked one by one.
TILE, HITS = 512, 1 << 15


def _matrix(column, dims: int) -> np.ndarray:
    import pyarrow as pa

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def choose_pivots(units: DataFrame, n: int, dims: int) -> np.ndarray:
    """A deterministic sample of at most MAX_PIVOTS distinct vectors: those with the smallest hashes.

    Of pivots that are close to each other the first stays, so that a dense group of vectors shares its pivot
    rather than dividing itself among many.
    """
    many = min(MAX_PIVOTS, max(MIN_PIVOTS, 1 << round(math.log2(PIVOTS * math.sqrt(max(n, 1))))))
    share = min(1.0, 1.2 * many / max(n, 1) + 64 / max(n, 1))
    h = F.shiftrightunsigned(F.xxhash64("v"), 1)
    near = units.select("v", h.alias("h")).filter(F.col("h") <= min(2**63 - 1, int(share * 2**63)))
    rows = near.orderBy("h", "v").limit(many).collect()
    sample = np.array([r["v"] for r in rows], np.float64).reshape(-1, dims)
    kept = np.ones(len(sample), bool)
    for i in range(len(sample)):
        if kept[i]:
            kept[i + 1 :] &= sample[i + 1 :] @ sample[i] < APART
    return sample[kept]


def _described(units: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """units with ``near``: ids of each vector's nearest pivots, nearest first."""
    known = units.sparkSession.sparkContext.broadcast(pivots.astype(np.float32))
    schema = T.StructType([*units.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])
    place = units.columns.index("v")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = known.value
        k = min(NEAREST, len(p))
        for batch in batches:
            x, near = _matrix(batch.column(place), dims).astype(np.float32), []
            for i in range(0, len(x), 512):
                sims = x[i : i + 512] @ p.T
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
                near.append(np.take_along_axis(top, order, 1))
            flat = pa.array(np.concatenate(near).ravel().astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "near"])

    return units.mapInArrow(run, schema)


@dataclass
class Members:
    """Vectors of one list that meet in a task, and what their comparison has found."""

    pivot: int
    x: np.ndarray
    near: np.ndarray
    weight: np.ndarray
    least: float
    shared: int

    def __post_init__(self):
        self.links = np.zeros(len(self.x), np.int64)
        self.edges: list[np.ndarray] = []

    def _holders(self, rows: np.ndarray, upto: int) -> dict[int, np.ndarray]:
        """Of each pivot among the first upto of these rows' descriptions the rows that have it, by place in rows."""
        flat = self.near[rows, :upto].ravel()
        by_pivot = np.argsort(flat, kind="stable")
        pivots, first = np.unique(flat[by_pivot], return_index=True)
        return dict(zip(pivots.tolist(), np.split(by_pivot // upto, first[1:])))

    def _others_out(self, hit: np.ndarray, a: np.ndarray, b: np.ndarray, second: int) -> None:
        """Leaves the pairs whose first shared posting pivot is this list's, and whose first further one is ``second``."""
        for upto, limit in ((min(PREFIX, self.near.shape[1]), self.pivot), (self.near.shape[1], second)):
            held = self._holders(b, upto) if limit > 0 else {}
            for pivot, rows in self._holders(a, upto).items() if held else ():
                if pivot < limit and pivot != self.pivot and pivot in held:
                    hit[np.ix_(rows, held[pivot])] = False

    def compare(self, a: np.ndarray, b: np.ndarray, second: int = -1) -> None:
        """Counts the links between two sets of rows (the same set, or apart) that belong to this list and ``second``;
        without a second pivot all that share enough pivots."""
        same = a is b
        for i in range(0, len(a), TILE):
            for j in range(i if same else 0, len(b), TILE):
                ia, ib = a[i : i + TILE], b[j : j + TILE]
                hit = self.x[ia] @ self.x[ib].T >= self.least
                if same and i == j:
                    hit = np.triu(hit, 1)
                n = np.count_nonzero(hit)
                if not n:
                    continue
                if n <= HITS:
                    p, q = np.nonzero(hit)
                    kept = self._own(ia[p], ib[q], second)
                    p, q = ia[p[kept]], ib[q[kept]]
                    np.add.at(self.links, p, self.weight[q])
                    np.add.at(self.links, q, self.weight[p])
                    self.edges.append(np.stack([p, q]))
                    continue
                if self.shared > (1 if second < 0 else 2):
                    enough = np.zeros(hit.shape, np.uint8)
                    held = self._holders(ib, self.near.shape[1])
                    for pivot, rows in self._holders(ia, self.near.shape[1]).items():
                        if pivot in held:
                            enough[np.ix_(rows, held[pivot])] += 1
                    hit &= enough >= self.shared
                self._others_out(hit, ia, ib, second)
                self.links[ia] += hit @ self.weight[ib]
                self.links[ib] += hit.T @ self.weight[ia]
                self._spanned(hit, ia, ib)

    def _own(self, p: np.ndarray, q: np.ndarray, second: int) -> np.ndarray:
        same = self.near[p][:, :, None] == self.near[q][:, None, :]
        common = np.where(same.any(2), self.near[p], MAX_PIVOTS)
        posted = np.where(same[:, :PREFIX, :PREFIX].any(2), self.near[p][:, :PREFIX], MAX_PIVOTS)
        kept = (posted.min(1) == self.pivot) & (same.any(2).sum(1) >= self.shared)
        return kept & (np.where(common == self.pivot, MAX_PIVOTS, common).min(1) == second) if second >= 0 else kept

    def _spanned(self, hit: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> None:
        """Edges that connect what the hits of a product connect, at most one for each row."""
        none = len(self.x)
        la, lb = np.where(hit.any(1), ia, none), np.where(hit.any(0), ib, none)
        while True:
            na = np.minimum(la, np.where(hit, lb[None, :], none).min(1))
            nb = np.minimum(lb, np.where(hit, na[:, None], none).min(0))
            if np.array_equal(na, la) and np.array_equal(nb, lb):
                break
            la, lb = na, nb
        self.edges.append(np.concatenate([np.stack([r[x < none], x[x < none]]) for r, x in ((ia, la), (ib, lb))], axis=1))

    def labels(self) -> np.ndarray:
        """Of each row the first one of its connected part."""
        label = np.arange(len(self.x))
        if self.edges:
            p, q = np.concatenate(self.edges, axis=1)
            while True:
                new = label.copy()
                np.minimum.at(new, p, label[q])
                np.minimum.at(new, q, label[p])
                new = new[new]
                if np.array_equal(new, label):
                    break
                label = new
        return label


def _list_links(lists: DataFrame, dims: int, least: float, shared: int) -> DataFrame:
    """(u, links, root): for each vector of a list how many vectors (copies counted) it is linked with there, and a
    vector of its connected part of that list. No pair is listed."""

    def run(table):
        import pyarrow as pa

        pivot, second, ba, bb = (table.column(c)[0].as_py() for c in ("pivot", "second", "ba", "bb"))
        u, w, block = (table.column(c).to_numpy() for c in ("u", "w", "block"))
        near = _matrix(table.column("near"), len(table.column("near")[0])).astype(np.int32)
        members = Members(pivot, _matrix(table.column("v"), dims), near, w, least, min(shared, near.shape[1]))
        everyone = np.arange(len(u))
        if ba != bb:
            members.compare(everyone[block == ba], everyone[block == bb], second)
        elif second >= 0 or len(u) <= TILE or members.shared < 2:
            members.compare(everyone, everyone, second)
        else:
            for further, rows in members._holders(everyone, near.shape[1]).items():
                if further != pivot and len(rows) > 1:
                    members.compare(rows, rows, further)
        keep = members.links > 0
        return pa.table({"u": u[keep], "links": members.links[keep], "root": u[members.labels()[keep]]})

    return lists.groupBy("pivot", "second", "ba", "bb").applyInArrow(run, "u long, links long, root long")


def _lists(described: DataFrame, long: int) -> DataFrame:
    """described posted in the lists of the first PREFIX pivots: pivot, second (-1 for a whole list), block, ba, bb.

    Vectors of a long list are posted by each further pivot instead, and where the two pivots' list is long too (a
    dense group) in each pair of its blocks.
    """
    posts = described.withColumn("pivot", F.explode(F.slice("near", 1, PREFIX)))
    # one number for each pivot, and there are at most MAX_PIVOTS of them
    sizes = posts.groupBy("pivot").agg((F.count(F.lit(1)) > long).alias("is_long"))
    posts = posts.join(F.broadcast(sizes), "pivot")
    keep = ["u", "w", "v", "near", "pivot"]
    whole = posts.filter("not is_long").select(*keep, *(F.lit(k).alias(c) for c, k in (("second", -1), ("block", 0), ("ba", 0), ("bb", 0))))
    further = F.filter("near", lambda x: x != F.col("pivot"))
    dealt = posts.filter("is_long").select(*keep, F.explode(F.when(F.size(further) > 0, further).otherwise(F.array(F.lit(-1)))).alias("second"))
    pairs = dealt.groupBy("pivot", "second").agg(F.ceil(F.count(F.lit(1)) / long).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = dealt.join(pairs, ["pivot", "second"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*keep, "second", "block", F.least("block", "other").alias("ba"), F.greatest("block", "other").alias("bb"))
    return whole.unionByName(dealt)


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, shared: int = SHARED, long: int = LONG
) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Links are pairs with cosine >= least, computed in double precision. Vectors that are null, empty, zero, or hold a
    null or non-finite component link with nothing; so do vectors of different lengths with each other (each length
    has an index of its own). Equal vectors become one vector with a weight before anything is compared; n_links counts
    all of its copies. Lists pass on counts and one edge per vector, never pairs; a list of more than ``long`` vectors is
    dealt out, so no task's rows grow with the table. Repeated ids count as vectors of their own and share results; null ids get
    component_id null unless linked with others. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = "forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    good = rows.filter(f"e is not null and size(e) > 0 and {finite}")
    classes = good.groupBy("e").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"))
    # scaling by the largest component first keeps squares of very large and very small vectors finite; each divisor is
    # bound to a variable, as it would be computed again for every component
    divided = "transform(array(named_struct('v', {0}, 'by', {1})), t -> transform(t.v, x -> x / t.by))[0]"
    scaled = divided.format("e", "array_max(transform(e, y -> abs(y)))")
    classes = classes.withColumn("s", F.expr(scaled))
    unit = F.expr(divided.format("s", "sqrt(aggregate(s, 0D, (a, y) -> a + y * y))"))
    classes = classes.select(F.monotonically_increasing_id().alias("u"), "e", "least", "w", unit.alias("v"))
    classes = scratch.table(classes)

    found = None
    for dims, n in sorted((r["dims"], r["count"]) for r in classes.groupBy(F.size("v").alias("dims")).count().collect()):
        units = classes.filter(F.size("v") == dims).select("u", "w", "v")
        described = scratch.table(_described(units, choose_pivots(units, n, dims), dims))
        lists = _lists(described, long)
        part = _list_links(lists, dims, least, shared)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.table(found)
    roots = connected_components(found.filter("u <> root").select(F.col("u").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    classes = classes.join(counts, "u", "left").join(roots, F.col("u") == F.col("node"), "left")
    classes = classes.select("e", "least", "w", F.coalesce("root", "u").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = scratch.table(classes)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(named, "root").select(F.col("e").alias("ce"), "component_id", (F.col("links") + F.col("w") - 1).alias("n_links"))
    out = rows.join(named, F.col("e") == F.col("ce"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
