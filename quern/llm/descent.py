"""Approximate nearest neighbours by largest inner product: a neighbour graph by NN-descent, searched greedily.

Building: every distinct vector starts with the best of a few blocks of vectors that look alike. Then, again and again,
the vectors around each node (its neighbours and those that it is a neighbour of) meet in a join and are compared
with each other, as neighbours of neighbours are likely neighbours; pairs both of which have met before are left
out. Searching: a query starts at a node and keeps a pool of the best nodes found; the neighbours of its best
open nodes are scored where their vectors lie, until no node of the pool is open.

Inner products of vectors of different lengths become cosines by one more component, which gives all vectors the
length of the longest. The graph is built with components of 16 bits; scores come from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.names import column
from quern.sources.scratch import Scratch

#: Neighbours of a node, nodes it is a neighbour of that take part, and pairs a comparison passes on for each vector of it.
NEIGHBOURS, REVERSE, PASSED = 32, 32, 12
#: Orders in which blocks of alike vectors are cut for the start, and vectors of a block.
ORDERS, BLOCK = 4, 512
#: Rounds at most; they end when fewer than this share of all edges is new.
ROUNDS, STILL = 6, 0.02
#: Pool of a query, and how many of its open nodes are expanded in a round.
POOL, WIDTH = 240, 60
#: Nodes whose surroundings are compared in one group; vectors of a group that scores candidates, and such groups at least.
TOGETHER, SHELF, SHELVES = 256, 4096, 32
#: Components of 16 bits.
_FULL = 32767


def is_valid(e: str) -> str:
    finite = f"forall({e}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return f"{e} is not null and size({e}) > 0 and {finite} and exists({e}, x -> x <> 0)"


def _flat(col) -> np.ndarray:
    import pyarrow as pa

    return (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten().to_numpy(zero_copy_only=False)


def _coded(col, dims: int) -> np.ndarray:
    """Rows of 16-bit components from an Arrow column of bytes, as doubles: products of them are exact."""
    import pyarrow as pa

    one = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(one.to_pylist()), np.int16).reshape(-1, dims).astype(np.float64)


def nodes_of(classes: DataFrame, dims: int, longest: float) -> DataFrame:
    """(u, q, s): vectors as components of 16 bits times s, with the component that makes them as long as the longest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _flat(batch.column(1)).astype(np.float64).reshape(-1, dims) / longest
            x = np.c_[x, np.sqrt(np.maximum(0, 1 - np.einsum("nd,nd->n", x, x)))]
            s = np.maximum(np.abs(x).max(axis=1), 1e-300) / _FULL
            q = np.rint(x / s[:, None]).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(s)], ["u", "q", "s"])

    return classes.select("u", "e").mapInArrow(run, "u long, q binary, s double")


def first_edges(nodes: DataFrame, n: int, dims: int, seed: int = 7) -> DataFrame:
    """(u, v, sim): each node's best of its block in some orders of all nodes. An order sorts by the signs of random
    projections, so that a block shares the first of them, and is cut into blocks of BLOCK, however alike the nodes are."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((ORDERS, 13, dims))

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _coded(batch.column(1), dims)
            for k in range(ORDERS):
                y = x @ planes[k].T
                key = (y[:, :12] > 0) @ (1 << np.arange(12)[::-1]) + np.arctan(y[:, 12] / _FULL) / np.pi + 0.5
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(key), *batch.columns], ["order", "key", "u", "q", "s"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        order, key, u, s = (table.column(c).to_numpy() for c in ("order", "key", "u", "s"))
        x = _coded(table.column("q"), dims)
        by = np.lexsort((u, key, order))
        for one in np.unique(order):
            own = by[order[by] == one]
            for rows in np.array_split(own, max(1, round(len(own) / BLOCK))):
                if len(rows) < 2:
                    continue
                sims = (x[rows] @ x[rows].T) * (s[rows][:, None] * s[rows])
                np.fill_diagonal(sims, -9)
                k = min(NEIGHBOURS, len(rows) - 1)
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(u[rows], k)), pa.array(u[rows][top].ravel()), pa.array(np.take_along_axis(sims, top, 1).ravel())], ["u", "v", "sim"]
                )

    keyed = nodes.mapInArrow(placed, "order int, key double, u long, q binary, s double")
    parts = ORDERS * n // (16 * BLOCK) + 1
    return keyed.repartitionByRange(parts, "order", "key", "u").mapInArrow(run, "u long, v long, sim double")


def best_edges(edges: DataFrame) -> DataFrame:
    """The NEIGHBOURS best of each node's edges (u, v, sim, fresh), each once; an edge known before is not fresh.

    Copies of an edge have one rank; each task leaves out what can't be among the best before anything is shuffled.
    """
    place = F.dense_rank().over(W.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    kept = edges.withColumn("place", place).filter(F.col("place") <= NEIGHBOURS)
    return kept.groupBy("u", "v", "sim").agg(F.min("fresh").alias("fresh"))


def around(edges: DataFrame) -> DataFrame:
    """(w, m, sim, fresh): of each node its neighbours and REVERSE of those that it is a neighbour of, chosen by hash, as
    the closest of them are mostly among its own neighbours."""
    back = edges.select(F.col("v").alias("w"), F.col("u").alias("m"), "sim", "fresh")
    place = F.row_number().over(W.partitionBy("w").orderBy(F.xxhash64("w", "m"), "m"))
    back = back.withColumn("place", place).filter(F.col("place") <= REVERSE).drop("place")
    both = edges.select(F.col("u").alias("w"), F.col("v").alias("m"), "sim", "fresh").unionByName(back)
    return both.groupBy("w", "m").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))


def met(members: DataFrame, groups: int, dims: int) -> DataFrame:
    """(u, v, sim) for pairs of vectors around a node that are new to each other and good enough for u's list."""

    def run(table):
        import pyarrow as pa

        w, m, fresh, s, least = (table.column(c).to_numpy() for c in ("w", "m", "fresh", "s", "least"))
        by = np.argsort(w, kind="stable")
        first = np.flatnonzero(np.r_[True, w[by][1:] != w[by][:-1]])
        sizes = np.diff(np.r_[first, len(w)])
        shape = (len(first), int(sizes.max()))
        row = np.repeat(np.arange(len(first)), sizes)
        col = np.arange(len(w)) - np.repeat(first, sizes)

        def spread(values, empty):
            out = np.full(shape, empty, values.dtype)
            out[row, col] = values[by]
            return out

        x = np.zeros((*shape, dims))
        x[row, col] = _coded(table.column("q"), dims)[by]
        ids, scale, new, low = spread(m, -1), spread(s, 0.0), spread(fresh, False), spread(least, np.inf)
        sims = (x @ x.transpose(0, 2, 1)) * (scale[:, :, None] * scale[:, None, :])
        good = (sims > low[:, :, None]) & (new[:, :, None] | new[:, None, :]) & (ids[:, None, :] >= 0) & (ids[:, :, None] != ids[:, None, :])
        sims = np.where(good, sims, -9)
        k = min(PASSED, shape[1])
        top = np.argpartition(-sims, k - 1, axis=2)[:, :, :k]
        best = np.take_along_axis(sims, top, 2)
        g, i, j = np.nonzero(best > -9)
        return pa.table({"u": ids[g, i], "v": ids[g, top[g, i, j]], "sim": best[g, i, j]})

    grouped = members.withColumn("group", F.pmod(F.xxhash64("w"), F.lit(groups)))
    return grouped.groupBy("group").applyInArrow(run, "u long, v long, sim double")


def neighbour_graph(nodes: DataFrame, n: int, dims: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v, sim, fresh) of the graph over nodes (u, q, s), written. A round moves 40 vectors a node, whatever n is."""
    edges = scratch.table(best_edges(first_edges(nodes, n, dims).withColumn("fresh", F.lit(True))))
    for _ in range(ROUNDS):
        lowest = edges.groupBy("u").agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("sim")).otherwise(-9.0).alias("least"))
        carried = nodes.join(lowest, "u", "left").select(F.col("u").alias("m"), "q", "s", F.coalesce("least", F.lit(-9.0)).alias("least"))
        members = around(edges).select("w", "m", "fresh").join(carried, "m")
        found = met(members, n // TOGETHER + 1, dims).withColumn("fresh", F.lit(True))
        before = edges
        edges = scratch.table(best_edges(before.withColumn("fresh", F.lit(False)).unionByName(found)))
        scratch.drop(before)
        fresh, total = edges.agg(F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
        if fresh <= STILL * total:
            break
    return edges


def scored(wanted: DataFrame, queries: DataFrame, shelves: DataFrame, dims: int) -> DataFrame:
    """(query, u, score) of the wanted (query, shelf, us), where the score passes the query's ``least``.

    A query's vector goes once to each shelf of vectors that holds nodes it wants.
    """

    def run(asked, held):
        import pyarrow as pa

        us = held.column("u").to_numpy()
        by = np.argsort(us)
        x = _flat(held.column("e")).astype(np.float64).reshape(-1, dims)[by]
        lists = asked.column("us").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        qe = _flat(asked.column("qe")).astype(np.float64).reshape(-1, dims)
        place, score = np.searchsorted(us[by], flat), np.empty(len(flat))
        for a in range(0, len(flat), 1 << 15):
            b = a + (1 << 15)
            score[a:b] = np.einsum("nd,nd->n", x[place[a:b]], qe[owner[a:b]])
        keep = score > asked.column("least").to_numpy()[owner]
        return pa.table({"query": asked.column("query").to_numpy()[owner[keep]], "u": flat[keep], "score": score[keep]})

    asked = wanted.join(queries, "query").select("query", F.col("shelf").alias("at"), "us", "qe", "least")
    return asked.groupBy("at").cogroup(shelves.groupBy("shelf")).applyInArrow(run, "query long, u long, score double")


def _shelf(u: str, shelves: int) -> Column:
    return F.pmod(F.xxhash64(u), F.lit(shelves))


def search(graph: DataFrame, classes: DataFrame, starts: DataFrame, n: int, dims: int, scratch: Scratch, pool: int = POOL) -> DataFrame:
    """(query, u, score): the pool of each query after a greedy search. graph: (w, m); starts: (query, qe, u)."""
    shelves = max(SHELVES, n // SHELF)
    vectors = classes.select("u", "e", _shelf("u", shelves).alias("shelf"))
    queries = starts.select("query", "qe")
    wanted = starts.groupBy("query", _shelf("u", shelves).alias("shelf")).agg(F.collect_set("u").alias("us"))
    none = F.lit(float("-inf"))
    state, order = None, [F.col("score").desc(), F.col("u")]
    while True:
        if state is None:
            lowest = queries.withColumn("least", none)
        else:
            lowest = state.groupBy("query").agg(F.when(F.count(F.lit(1)) >= pool, F.min("score")).otherwise(none).alias("least")).join(queries, "query")
        found = scored(wanted, lowest, vectors, dims).withColumn("open", F.lit(True))
        if state is not None:
            found = state.select("query", "u", "score", F.expr("open and not expand").alias("open")).unionByName(found)
        # a node that has been found before comes again with its own score
        found = found.groupBy("query", "u").agg(F.max("score").alias("score"), F.min("open").alias("open"))
        by_query = W.partitionBy("query").orderBy(*order)
        best = found.withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= pool)
        nth = F.sum(F.col("open").cast("int")).over(by_query.rowsBetween(W.unboundedPreceding, 0))
        after = scratch.table(best.select("query", "u", "score", "open", (F.col("open") & (nth <= WIDTH)).alias("expand")))
        if state is not None:
            scratch.drop(state)
        state = after
        if state.filter("expand").isEmpty():
            return state.select("query", "u", "score")
        beyond = state.filter("expand").select("query", F.col("u").alias("w")).join(graph, "w")
        wanted = beyond.groupBy("query", _shelf("m", shelves).alias("shelf")).agg(F.collect_set("m").alias("us"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pool: int = POOL) -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``: query_id, rank, id_col, score.

    Nearness is the largest inner product of the original vectors, in double precision; ties go to smaller ids. Vectors
    that are null, empty, zero or hold a null or non-finite component take no part; vectors of different
    lengths are no candidates for each other. Rows with one id and one vector are one candidate and one query; rows
    with the query's id are no candidates for it; a null id is a candidate, after others with its score, and no query.
    Equal vectors are one node, and one search, of which the k + 1 smallest ids are all that can be needed. With at most
    ``pool`` distinct vectors all are found. An empty table gives no rows; other columns are not read.

    The search is approximate: lists of neighbours, reverse lists and pools are bounded by its method. Every row is indexed.
    """
    scratch = Scratch(vectors.sparkSession, "descent")
    rows = vectors.select(column(id_col).alias("id"), column(vector_col).cast("array<double>").alias("e")).filter(is_valid("e"))
    ids = rows.distinct().withColumn("nth", F.row_number().over(W.partitionBy("e").orderBy(F.col("id").asc_nulls_last())))
    ids = ids.filter(F.col("nth") <= k + 1)
    classes = ids.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("ids"))
    size = F.expr("array_max(transform(e, x -> abs(x))) * sqrt(aggregate(transform(e, x -> pow(x / array_max(transform(e, y -> abs(y))), 2)), 0D, (a, x) -> a + x))")
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("u"), "e", "ids", size.alias("length")))
    asked = rows.filter(F.col("id") % every == 0).distinct().join(classes.select("u", "e"), "e").select(F.col("id").alias("query_id"), F.col("u").alias("query"))
    asked = scratch.table(asked)
    answers = None
    for dims, n, longest in sorted(tuple(r) for r in classes.groupBy(F.size("e")).agg(F.count(F.lit(1)), F.max("length")).collect()):
        own = classes.filter(F.size("e") == dims)
        nodes = scratch.table(nodes_of(own, dims, longest))
        edges = neighbour_graph(nodes, n, dims + 1, scratch)
        graph = scratch.table(around(edges).select("w", "m"))
        starts = own.join(asked.select(F.col("query").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("query"), F.col("e").alias("qe"), "u")
        found = search(graph, own, starts, n, dims, scratch, pool)
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    # equal scores at the end of a list may hide smaller ids
    reach = F.rank().over(W.partitionBy("query").orderBy(F.col("score").desc()))
    answers = answers.withColumn("place", reach).filter(F.col("place") <= k + 1).join(classes.select("u", F.col("ids.id").alias("ids")), "u")
    answers = answers.select("query", "score", F.explode("ids").alias("id")).join(asked, "query").filter("not id <=> query_id")
    place = F.row_number().over(W.partitionBy("query", "query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    answers = answers.withColumn("rank", place).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", F.col("id").alias(id_col), "score")
