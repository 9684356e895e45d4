"""Hybrid retrieval: exact cosine top-k, BM25 top-k, and their fusion by reciprocal rank.

Query and records go through one analyzer: folded words, then English stems. Where there is an index (``postings``), a
query reads its terms' blocks; without one, texts are analysed once a query, where they stand, into a narrow table of lengths and
term counts. Every ranking is cut to its top k (TakeOrderedAndProject) before anything is ranked or joined, and only the
winners' texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.stemming import stem, stems
from quern.functions.text import cosine, folded_tokens, safe_truncate, tokens_of
from quern.operators.cells import Cells
from quern.operators.postings import Postings, bm25, is_visible
from quern.sources.scratch import Scratch

RRF_K, CANDIDATES, MOST = 60, 20, 50
#: Stems that words of another second letter have: dying, lying, tying.
SHORT = ("die", "lie", "tie")


def analyze(query: str) -> list[str]:
    """The distinct terms of a query text, in order."""
    return list(dict.fromkeys(map(stem, tokens_of(query))))


def visible(memory: DataFrame, project: str) -> DataFrame:
    return memory.filter((F.col("project") == project) & is_visible())


def _start(term: str) -> str:
    """What every word with this stem starts with."""
    return term[: 1 if len(term) < 3 or term in SHORT else 2]


def analyzed(memory: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(key, project, created_at, visible, dl, tf): of each record its number of tokens and how often it holds each term.

    Written once, without texts. Only tokens that start like a term are stemmed. A null content has no tokens.
    """
    starts = sorted({_start(t) for t in terms})
    near = lambda x: F.lit(False) if not starts else F.substring(x, 1, 2).isin(*starts) | F.substring(x, 1, 1).isin(*starts)
    tokens = F.coalesce(folded_tokens(F.col("content")), F.array().cast("array<string>"))
    # the tokens are bound to a variable, as each use would compute them again
    read = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("dl"), F.filter(t, near).alias("near")))[0]
    rows = memory.select("key", "project", "created_at", is_visible().alias("visible"), read.alias("r"))
    rows = rows.select("key", "project", "created_at", "visible", "r.dl", stems(F.col("r.near")).alias("near"))
    tf = F.array(*[F.size("near") - F.size(F.array_remove("near", t)) for t in terms]).cast("array<int>")
    return Scratch(memory.sparkSession, "terms").table(rows.select("key", "project", "created_at", "visible", "dl", tf.alias("tf")))


def term_statistics(rows: DataFrame, n_terms: int) -> DataFrame:
    """One row of ``analyzed`` records: n, avgdl, and df, the number of records that hold each term."""
    df = [F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(n_terms)]
    one = rows.agg(F.count("dl").alias("n"), F.avg("dl").alias("avgdl"), *df)
    return one.select("n", "avgdl", F.array(*[F.coalesce(f"df{i}", F.lit(0)) for i in range(n_terms)]).alias("df"))


def bm25_ranked(memory: DataFrame, project: str, query: str) -> DataFrame:
    """(key, created_at, score) of visible records that hold every term of the query; statistics are over all records.

    A query without a word finds nothing.
    """
    terms = analyze(query)
    rows = analyzed(memory, terms)
    found = rows.filter((F.col("project") == project) & F.col("visible") & F.lit(bool(terms)))
    for i in range(len(terms)):
        found = found.filter(F.col("tf")[i] > 0)
    scored = found.crossJoin(F.broadcast(term_statistics(rows, len(terms))))  # one row
    parts = [bm25(F.col("tf")[i], F.col("dl"), F.col("df")[i], F.col("n"), F.col("avgdl")) for i in range(len(terms))]
    return scored.select("key", "created_at", F.round(sum(parts[1:], parts[0]) if parts else F.lit(0.0), 6).alias("score"))


def knn_ranked(memory: DataFrame, vectors: DataFrame, project: str, vector: DataFrame) -> DataFrame:
    """(key, created_at, score): visible records that have a vector in (project, key, embedding), with their cosine to the
    one row ``qvec`` of vector. No text is read. A vector that has no cosine with it (null, zero, not finite, of another
    length) is not ranked; if that is the query's, nothing is."""
    own = visible(memory, project).select("key", "created_at")
    near = vectors.filter((F.col("project") == project) & F.col("embedding").isNotNull()).select("key", "embedding")
    found = near.join(own, "key").crossJoin(F.broadcast(vector.limit(1)))
    found = found.select("key", "created_at", F.round(cosine(F.col("embedding"), F.col("qvec")), 6).alias("score"))
    return found.filter(F.col("score").isNotNull() & ~F.isnan("score"))


def top(ranked: DataFrame, k: int, *tie: Column) -> DataFrame:
    return ranked.orderBy(F.col("score").desc(), *tie, "key").limit(k)


def bm25_top(memory: DataFrame, project: str, query: str, k: int, *tie: Column, index: Postings | None = None) -> DataFrame:
    """``top`` of ``bm25_ranked``: from the index of memory if there is one, else by reading every text."""
    if index is not None:
        return index.top(project, analyze(query), k, *tie)
    return top(bm25_ranked(memory, project, query), k, *tie)


def knn_top(memory: DataFrame, vectors: DataFrame, project: str, vector: DataFrame, k: int, cells: Cells | None = None) -> DataFrame:
    """``top`` of ``knn_ranked``: from the vector index of memory and vectors if there is one, else by reading every vector."""
    return cells.top(project, vector, k) if cells is not None else top(knn_ranked(memory, vectors, project, vector), k)


def _positions(candidates: DataFrame) -> DataFrame:
    """0-based rank of at most CANDIDATES rows."""
    return candidates.select("key", (F.row_number().over(W.orderBy(F.col("score").desc(), "key")) - 1).alias("rank"))


def fused(vector_top: DataFrame, text_top: DataFrame) -> DataFrame:
    """(key, score): sum of 1 / (60 + rank) over the lists that hold the key, by a full outer join."""
    v, t = _positions(vector_top).withColumnRenamed("rank", "vrank"), _positions(text_top).withColumnRenamed("rank", "trank")
    part = lambda r: F.coalesce(1 / (RRF_K + F.col(r)), F.lit(0.0))
    return v.join(t, "key", "full_outer").select("key", F.round(part("vrank") + part("trank"), 9).alias("score"))


def fused_by_union(vector_top: DataFrame, text_top: DataFrame) -> DataFrame:
    """The same scores by a union and a sum."""
    both = _positions(vector_top).unionByName(_positions(text_top))
    return both.groupBy("key").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"))


def recall(
    memory: DataFrame, project: str, query: str, vectors: DataFrame | None = None, vector: DataFrame | None = None, limit: int = 5, index: Postings | None = None,
    cells: Cells | None = None,
) -> DataFrame:
    """At most limit (50 at most) visible records, best first: fused if there is a query vector, else by BM25.

    Columns: key, content, project, created_at, agent_id, score, search_mode. memory: keyed records; vectors: (project, key,
    embedding).
    """
    limit = min(limit, MOST)
    if vector is None:
        best, mode = bm25_top(memory, project, query, limit, F.col("created_at").desc(), index=index), "bm25"
    else:
        by_text = bm25_top(memory, project, query, CANDIDATES, index=index)
        best, mode = top(fused(knn_top(memory, vectors, project, vector, CANDIDATES, cells), by_text), limit), "vector+bm25"
    # MOST rows at most; a record's key is its own
    records = visible(memory, project).select("key", "content", "project", "created_at", "agent_id")
    found = records.join(F.broadcast(best.select("key", "score")), "key")
    return found.withColumn("search_mode", F.lit(mode))


def recall_by_text(
    memory: DataFrame, project: str, query: str, vectors: DataFrame, embed: Callable[[str], Sequence[float]] | None, limit: int = 5
) -> DataFrame:
    """``recall`` of a query text: embedded if there is an embedder and it succeeds, else by BM25 alone."""
    vector = None
    if embed is not None:
        try:
            values = [float(x) for x in embed(query)]
            vector = memory.sparkSession.createDataFrame([(values,)], "qvec array<double>")
        except Exception:  # whatever fails in an embedder, the text still decides
            vector = None
    return recall(memory, project, query, vectors, vector, limit)


def remembered(memory: DataFrame, vectors: DataFrame, record: dict, embed: Callable[[str], Sequence[float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots of memory and vectors after a record is stored.

    The log of its project and key, the record last, is folded: the last values stay, token counters add up, and one that the
    record leaves out keeps its sum. Its vector (project, key, embedding) takes the place of the one of its project and key,
    even by none where there is no embedder or it fails. Records of other projects with that key stay as they are.
    """
    spark = memory.sparkSession
    try:
        values = [float(x) for x in embed(record["content"])] if embed else None
    except Exception:  # a record without a vector can still be found by its text
        values = None
    same = F.col("project").eqNullSafe(F.lit(record.get("project"))) & F.col("key").eqNullSafe(F.lit(record["key"]))
    row = spark.createDataFrame([tuple(record.get(c) for c in memory.columns)], memory.schema)
    counters = [c for c in ("token_saved", "token_usage") if c in memory.columns]
    last = [c for c in memory.columns if c not in ("project", "key", *counters)]
    log = memory.filter(same).withColumn("__n", F.lit(0)).unionByName(row.withColumn("__n", F.lit(1)))
    now = log.groupBy("project", "key").agg(F.max_by(F.struct(*last), "__n").alias("__last"), *[F.sum(c).alias(c) for c in counters])
    vector = spark.createDataFrame([(record.get("project"), record["key"], values)], "project string, key string, embedding array<double>")
    return memory.filter(~same).unionByName(now.select("project", "key", "__last.*", *counters)), vectors.filter(~same).unionByName(vector)


def formatted(recalled: DataFrame, most: int = 4096) -> DataFrame:
    """(key, entry): a text entry per record, its content cut to most bytes."""
    agent = F.coalesce("agent_id", F.lit("Unknown"))
    when = F.date_format("created_at", "yyyy-MM-dd HH:mm 'UTC'")
    entry = F.concat(F.lit("["), "key", F.lit("] "), when, F.lit(" by "), agent, F.lit("\n"), safe_truncate(F.col("content"), most))
    return recalled.select("key", entry.alias("entry"))
