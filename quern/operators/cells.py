"""A written vector index: exact cosine top k that reads few vectors.

Layout, in Parquet under one folder: ``centroids``, a bounded sample of the vectors; ``codes``, one narrow row a vector, ordered by
project and cell, with its direction in bytes and the exact length of what the bytes leave out; ``cells``, the number of
vectors of a cell and the largest angle to its centroid; ``vectors`` by bucket of the key. ``cells`` is written last.

A query bounds the cosine of a cell's vectors by angles and opens the codes of cells that can reach the k-th score; a code
bounds its vector's cosine from both sides, by the inequality of Cauchy and Schwarz, and only vectors whose upper bound reaches the
k-th lower bound are read and scored. Where directions are independent the angles rule out no cell, as in any such
index, and the codes still rule out nearly all vectors. A vector that has no direction in doubles (null components, zero, not
finite, lengths beyond the squares of doubles) is bounded by nothing and always read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import cosine
from quern.operators.postings import is_visible

#: Centroids at most; vectors to a centroid, about, while there are fewer.
CENTROIDS, MEMBERS = 1024, 64
#: Vectors to a bucket of the key, and buckets at most.
BUCKET, BUCKETS = 1 << 16, 4096
#: Keys that are looked up by a filter on the scan; more are joined.
LOOKED_UP = 1024
#: Scores are rounded to six places; errors of doubles stay below the rest.
SLACK = 1e-6 + 1e-9
#: The cell of what lies in no cell.
LOOSE = -1

CODES = "project string, visible boolean, dims int, cell int, key string, created_at timestamp_ntz, code binary, scale double, error double, angle double"

TABLES = {
    "codes": CODES, "centroids": "embedding array<double>", "cells": "project string, visible boolean, dims int, cell int, n long, angle double",
    "vectors": "project string, visible boolean, key string, created_at timestamp_ntz, embedding array<double>, bucket int",
}


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one, and which rows have a direction."""
    with np.errstate(all="ignore"):
        square = np.einsum("nd,nd->n", x, x)
        plain = np.isfinite(square) & (square > 1e-280)
        return np.where(plain[:, None], x / np.sqrt(square)[:, None], 0.0), plain


def _code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as bytes, their scale, and the length of the difference."""
    scale = np.maximum(np.abs(x).max(axis=1, initial=0.0), 1e-300) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    left = x - code * scale[:, None]
    return code, scale, np.sqrt(np.einsum("nd,nd->n", left, left)) + 1e-9


@dataclass
class Cells:
    """The index under a folder."""

    spark: SparkSession
    root: str

    def build(self, memory: DataFrame, vectors: DataFrame) -> Cells:
        """Writes the index of vectors (project, key, embedding) of the records of memory (project, key, created_at, tags)."""
        own = memory.select("project", "key", "created_at", is_visible().alias("visible"))
        rows = vectors.filter(F.col("embedding").isNotNull()).join(own, ["project", "key"])
        n = vectors.count()
        buckets = max(1, min(BUCKETS, n // BUCKET))
        stored = rows.select("project", "visible", "key", "created_at", "embedding", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"))
        stored.repartition(buckets, "bucket").sortWithinPartitions("project", "key").write.partitionBy("bucket").parquet(f"{self.root}/vectors")
        read = self._table("vectors")

        # a sample by hash, at most CENTROIDS rows
        some = vectors.filter(F.expr("size(embedding) > 0 and not exists(embedding, x -> x is null)")).withColumn("h", F.xxhash64("project", "key"))
        picked = some.orderBy("h", "project", "key").limit(max(1, min(CENTROIDS, n // MEMBERS)))
        picked.select("embedding").coalesce(1).write.parquet(f"{self.root}/centroids")
        by_dims = self._centroids()

        def encode(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                lists = batch.column("embedding")
                flat, cuts = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
                sizes = np.diff(cuts)
                for dims in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dims)
                    x, plain = _directions(flat[cuts[at][:, None] + np.arange(dims)])
                    code, scale, error = _code(x)
                    cell, angle = np.full(len(at), LOOSE), np.full(len(at), np.pi)
                    if dims in by_dims:
                        numbers, centres = by_dims[dims]
                        dots = x @ centres.T
                        near = dots.argmax(axis=1)
                        cell[plain] = numbers[near[plain]]
                        angle[plain] = np.arccos(np.clip(dots[np.arange(len(at)), near], -1, 1))[plain]
                    error[~plain] = 2.0
                    kept = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [kept.column("project"), kept.column("visible"), pa.array(np.full(len(at), dims, np.int32)), pa.array(cell.astype(np.int32)), kept.column("key"),
                         kept.column("created_at"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error), pa.array(angle)],
                        [c.split()[0] for c in CODES.split(", ")],
                    )

        codes = read.select("project", "visible", "key", "created_at", "embedding").mapInArrow(encode, CODES)
        # a project with a third of all vectors is spread by its cells
        codes.repartitionByRange("project", "visible", "dims", "cell", "key").sortWithinPartitions("project", "visible", "dims", "cell").write.parquet(f"{self.root}/codes")
        cells = self._table("codes").groupBy("project", "visible", "dims", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"))
        cells.write.parquet(f"{self.root}/cells")
        return self

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/cells/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _centroids(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Numbers and directions of the centroids, by their number of components. A centroid's number is its place in the
        ordered table of at most CENTROIDS rows."""
        found: dict[int, list] = {}
        for number, row in enumerate(self._table("centroids").orderBy("embedding").collect()):
            x, plain = _directions(np.array([row["embedding"]]))
            if plain[0]:
                found.setdefault(x.shape[1], []).append((number, x[0]))
        return {dims: (np.array([i for i, _ in own]), np.array([x for _, x in own])) for dims, own in found.items()}

    def _bounded(self, project: str, y: np.ndarray, cells: list[int], least: float) -> DataFrame:
        """(key, lower, upper) of the codes of some cells whose upper bound reaches ``least``."""
        codes = self._table("codes").filter((F.col("project") == project) & F.col("visible") & (F.col("dims") == len(y)) & F.col("cell").isin(cells))

        def bound(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                q = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(len(batch), -1)
                about, error = (q @ y) * batch.column("scale").to_numpy(), batch.column("error").to_numpy()
                keep = about + error >= least
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").filter(pa.array(keep)), pa.array((about - error)[keep]), pa.array((about + error)[keep])], ["key", "lower", "upper"]
                )

        return codes.select("key", "code", "scale", "error").mapInArrow(bound, "key string, lower double, upper double")

    @staticmethod
    def _reached(bounded: DataFrame, k: int) -> float:
        """A score that k of the vectors reach, less the slack."""
        best = bounded.orderBy(F.col("lower").desc()).select("lower").limit(k).collect()
        return best[-1]["lower"] - SLACK if len(best) == k else -np.inf

    def candidates(self, project: str, qvec: list, k: int) -> DataFrame:
        """(key): visible records of a project among which are the k with the largest cosine to qvec, ties included."""
        y = _directions(np.array([qvec], np.float64))[0][0]
        cells = self._table("cells").filter((F.col("project") == project) & F.col("visible") & (F.col("dims") == len(y))).collect()  # CENTROIDS + 1 rows at most
        numbers, centres = self._centroids().get(len(y), (np.zeros(0, int), np.zeros((0, len(y)))))
        apart = dict(zip(numbers.tolist(), np.arccos(np.clip(centres @ y, -1, 1)).tolist()))
        most = {r["cell"]: 2.0 if r["cell"] == LOOSE else float(np.cos(max(0.0, apart[r["cell"]] - r["angle"]))) for r in cells}
        first, members = [], 0
        for r in sorted(cells, key=lambda r: apart.get(r["cell"], np.inf)):
            if members >= 4 * k:
                break
            first.append(r["cell"])
            members += r["n"]
        least = self._reached(self._bounded(project, y, first, -np.inf), k)
        near = self._bounded(project, y, [c for c, upper in most.items() if upper >= least], least)
        return near.filter(F.col("upper") >= self._reached(near, k)).select("key")

    def top(self, project: str, vector: DataFrame, k: int) -> DataFrame:
        """(key, created_at, score): the k visible records with the largest cosine to the one row ``qvec`` of vector, as
        ``retrieval.knn_ranked`` gives them, best first, ties by key."""
        asked = vector.limit(1).collect()
        qvec = asked[0]["qvec"] if asked else None
        stored = self._table("vectors").filter((F.col("project") == project) & F.col("visible"))
        if qvec is None or None in qvec or not len(qvec) or not _directions(np.array([qvec], np.float64))[1][0]:
            if qvec is None:
                return stored.select("key", "created_at", F.lit(0.0).alias("score")).limit(0)
            found = stored  # no bound holds for such a query
        else:
            near = self.candidates(project, qvec, k).distinct()
            keys = [r["key"] for r in near.limit(LOOKED_UP + 1).collect()]
            if len(keys) <= LOOKED_UP:
                found = stored.filter(F.col("key").isin(keys))
            else:
                found = stored.join(near, "key", "left_semi")
        y = F.lit(None).cast("array<double>") if qvec is None else F.array(*[F.lit(x).cast("double") for x in qvec])
        scored = found.select("key", "created_at", F.round(cosine(F.col("embedding"), y), 6).alias("score"))
        return scored.filter(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.col("score").desc(), "key").limit(k)
