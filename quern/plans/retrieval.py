"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.stemming import term_counts
from quern.functions.text import folded_tokens, lower_tokens
from quern.operators import retrieval as R
from quern.operators.cells import Cells
from quern.operators.postings import Postings
from quern.plans import views as V
from quern.sources.scratch import Scratch, file_states

PROJECT, QUERY, VECTOR, LIMIT = "en", "The, and", 7, 10


def _vector(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == VECTOR)
    return e.select(F.col("embedding").cast("array<double>").alias("qvec"))


def _day(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


_INDEXES: dict[tuple, Postings] = {}


def text_index(spark, sf_dir):
    """The full-text index of the records, which the session's first query on just these files writes."""
    held = (spark.sparkContext.applicationId, file_states(spark, f"{sf_dir}/documents.parquet"))
    if held not in _INDEXES or not _INDEXES[held].exists():
        _INDEXES[held] = Postings(spark, Scratch(spark, "text-index").root).build(V.memory(spark, sf_dir))
    return _INDEXES[held]


_CELLS: dict[tuple, Cells] = {}


def vector_index(spark, sf_dir):
    """The vector index of the records, which the session's first query on just these files writes."""
    held = (spark.sparkContext.applicationId, *[file_states(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings")])
    if held not in _CELLS or not _CELLS[held].exists():
        _CELLS[held] = Cells(spark, Scratch(spark, "vector-index").root).build(V.memory(spark, sf_dir), V.vectors(spark, sf_dir))
    return _CELLS[held]


def knn_top20(spark, sf_dir):
    return vector_index(spark, sf_dir).top(PROJECT, _vector(spark, sf_dir), 20).select("key", "score")


def bm25_top20(spark, sf_dir):
    return R.bm25_top(V.memory(spark, sf_dir), PROJECT, QUERY, 20, index=text_index(spark, sf_dir)).select("key", "score")


def bm25_stats(spark, sf_dir):
    terms = R.analyze(QUERY)
    stats = text_index(spark, sf_dir).statistics(terms)
    row = (stats.n, None if stats.avgdl is None else round(stats.avgdl, 6), *stats.df)
    return spark.createDataFrame([row], "n long, avgdl double, " + ", ".join(f"df_{t} long" for t in terms))


def recall_hybrid_rrf(spark, sf_dir):
    out = R.recall(V.memory(spark, sf_dir), PROJECT, QUERY, V.vectors(spark, sf_dir), _vector(spark, sf_dir), LIMIT, text_index(spark, sf_dir), vector_index(spark, sf_dir))
    return _day(out).drop("content")


def recall_bm25_only(spark, sf_dir):
    return _day(R.recall(V.memory(spark, sf_dir), PROJECT, QUERY, limit=LIMIT, index=text_index(spark, sf_dir))).drop("content")


def recall_formatted(spark, sf_dir):
    return R.formatted(R.recall(V.memory(spark, sf_dir), PROJECT, QUERY, limit=LIMIT, index=text_index(spark, sf_dir)), 400)


def _lists(spark, sf_dir):
    m = V.memory(spark, sf_dir)
    return vector_index(spark, sf_dir).top(PROJECT, _vector(spark, sf_dir), 20), R.bm25_top(m, PROJECT, QUERY, 20, index=text_index(spark, sf_dir))


def rrf_full_outer(spark, sf_dir):
    return R.fused(*_lists(spark, sf_dir))


def rrf_union_variant(spark, sf_dir):
    return R.fused_by_union(*_lists(spark, sf_dir))


def analyze_tokens(spark, sf_dir):
    """How often each token stands in the corpus, and in how many records."""
    t = V.memory(spark, sf_dir).select("key", F.explode(folded_tokens(F.col("content"))).alias("token"))
    per = t.groupBy("token", "key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("records"))


def analyze_stems(spark, sf_dir):
    """How often each English stem stands in the corpus, and in how many records."""
    # rows of one key are one record
    t = V.memory(spark, sf_dir).groupBy("key").agg(F.collect_list("content").alias("texts"))
    rows = t.select(F.flatten(F.transform("texts", lower_tokens)).alias("words"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, stems, _, at, n in term_counts(batches, "words"):
            times, records = np.bincount(at, n, len(stems)).astype(np.int64), np.bincount(at, minlength=len(stems))
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(times), pa.array(records)], ["stem", "times", "records"])

    per = rows.mapInArrow(run, "stem string, times long, records long")
    return per.groupBy("stem").agg(F.sum("times").alias("times"), F.sum("records").alias("records"))


def filter_tag_contains(spark, sf_dir):
    return V.memory(spark, sf_dir).filter(F.array_contains("tags", "roi")).select("key", F.array_join("tags", ",").alias("tags"))


def filter_tag_not_contains(spark, sf_dir):
    m = V.memory(spark, sf_dir)
    return m.filter(~F.coalesce(F.array_contains("tags", "roi"), F.lit(False))).select("key", F.array_join("tags", ",").alias("tags"))


QUERIES = {f.__name__: f for f in (recall_hybrid_rrf, recall_bm25_only, recall_formatted, knn_top20, bm25_top20, bm25_stats, rrf_full_outer, rrf_union_variant, analyze_tokens, analyze_stems, filter_tag_contains, filter_tag_not_contains)}

_TOKENS = "regexp_extract_all(translate(lower(content), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\\p{L}+|\\p{N}+')"
# SQL has no stems: these are the words with the stem "and"; "the" is alone with its own.
_AND = "('and', 'ands', 'anded', 'anding', 'andly', 'andlyedly')"
_RANKED = f"""{V.MEMORY},
t AS (SELECT * EXCLUDE (tokens), len(tokens) AS dl, len(list_filter(tokens, lambda x: x = 'the')) AS tf0,
             len(list_filter(tokens, lambda x: x IN {_AND})) AS tf1 FROM (SELECT *, {_TOKENS} AS tokens FROM v_memory)),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count_if(tf0 > 0) AS df0, count_if(tf1 > 0) AS df1 FROM t),
vis AS (SELECT * FROM t WHERE project = 'en' AND NOT list_contains(tags, 'roi')),
lex AS (SELECT vis.*, round(ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
                          + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score
        FROM vis, s WHERE tf0 > 0 AND tf1 > 0),
sem AS (SELECT vis.*, round(list_cosine_similarity(embedding, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS score
        FROM vis WHERE embedding IS NOT NULL),
lex20 AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) - 1 AS r FROM lex QUALIFY r < 20),
sem20 AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) - 1 AS r FROM sem QUALIFY r < 20),
rrf AS (SELECT key, round(sum(1 / (60 + r)), 9) AS score FROM (SELECT key, r FROM sem20 UNION ALL SELECT key, r FROM lex20) GROUP BY key)"""
_CREATED = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"

ORACLE_SQL = {
    "knn_top20": f"WITH {_RANKED} SELECT key, score FROM sem20",
    "bm25_top20": f"WITH {_RANKED} SELECT key, score FROM lex20",
    "bm25_stats": f"WITH {_RANKED} SELECT n, round(avgdl, 6) AS avgdl, CAST(df0 AS BIGINT) AS df_the, CAST(df1 AS BIGINT) AS df_and FROM s",
    "recall_hybrid_rrf": f"""WITH {_RANKED} SELECT key, project, {_CREATED}, agent_id, score, 'vector+bm25' AS search_mode
        FROM (SELECT * FROM rrf ORDER BY score DESC, key LIMIT 10) JOIN v_memory USING (key)""",
    "recall_bm25_only": f"""WITH {_RANKED} SELECT key, project, {_CREATED}, agent_id, score, 'bm25' AS search_mode
        FROM (SELECT * FROM lex ORDER BY score DESC, lex.created_at DESC, key LIMIT 10)""",
    "recall_formatted": f"""WITH {_RANKED} SELECT key, '[' || key || '] ' || strftime(created_at, '%Y-%m-%d %H:%M UTC') || ' by ' || coalesce(agent_id, 'Unknown') || chr(10) ||
            CASE WHEN strlen(content) <= 400 THEN content
                 ELSE left(content, list_max(list_filter(range(0, 401), lambda n: strlen(left(content, n)) <= 400))) || chr(10) || '... [output truncated]' END AS entry
        FROM (SELECT * FROM lex ORDER BY score DESC, lex.created_at DESC, key LIMIT 10)""",
    "rrf_full_outer": f"WITH {_RANKED} SELECT key, score FROM rrf",
    "rrf_union_variant": f"WITH {_RANKED} SELECT key, score FROM rrf",
    "analyze_tokens": f"""WITH {V.MEMORY}, x AS (SELECT key, unnest({_TOKENS}) AS token FROM v_memory)
        SELECT token, count(*) AS times, count(DISTINCT key) AS records FROM x GROUP BY token""",
    "filter_tag_contains": f"WITH {V.MEMORY} SELECT key, array_to_string(tags, ',') AS tags FROM v_memory WHERE list_contains(tags, 'roi')",
    "filter_tag_not_contains": f"WITH {V.MEMORY} SELECT key, array_to_string(tags, ',') AS tags FROM v_memory WHERE NOT list_contains(tags, 'roi')",
}
