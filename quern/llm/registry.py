"""The queries of this package: thin digests of what its operators return, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("notices")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pivots import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.token_files import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import mix_table

    mixed = mix_table(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.interactions import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.descent import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash": op3_simhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_html_text": op9_html_text,
    "op10_lm_scores": op10_lm_scores,
    "op11_filter_audit": op11_filter_audit,
    "op12_phrases": op12_phrases,
    "op13_neighbours": op13_neighbours,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
        w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                     CAST(source_size AS DOUBLE) * 2 AS cap FROM k),
        l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
                         - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                        / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM w),
        t AS (SELECT *, least(cap, weight * (SELECT arg_min(level, k_order) FROM
                        (SELECT level, row_number() OVER (ORDER BY cap / weight, k) AS k_order, cap / weight AS fills FROM l)
                        WHERE level <= fills)) AS target FROM l),
        b AS (SELECT source, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
        c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                     sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (whole + CASE WHEN upto <= budget THEN 1
                                    WHEN upto - tied <= budget AND upto - budget < budget - (upto - tied) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM c""",
    "op11_filter_audit": r"""
        WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        f AS (SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
                     + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS INT)
                     + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask FROM w),
        c AS (SELECT part, mask, count(*) AS docs, sum(CAST(coalesce(good, false) AS INT)) AS good, sum(CAST(coalesce(toxic, false) AS INT)) AS toxic
              FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || p.x || q.x || e.x AS filter_order FROM x a, x b, x p, x q, x e
              WHERE len(list_distinct([a.x, b.x, p.x, q.x, e.x])) = 5),
        k AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
        s AS (SELECT filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit,
                     CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS BIGINT) AS before FROM k),
        r AS (SELECT part, filter_order, step, letter,
                     sum(CASE WHEN mask & (before | bit) = 0 THEN docs ELSE 0 END) AS kept,
                     sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN docs ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN docs ELSE 0 END) AS redundant,
                     sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM s CROSS JOIN c GROUP BY part, filter_order, step, letter)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r""",
    "op12_phrases": rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
        p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
        g AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS a FROM s CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
              GROUP BY lang, w[i:i + k - 1] HAVING count(*) >= 30),
        c AS (SELECT lang, g, a FROM g WHERE len(g) >= 2),
        x AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
        y AS (SELECT x.lang, x.g, x.a, x.k, l.a AS l, r.a AS r, CAST(2000000 * CAST(x.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score
              FROM x JOIN g l ON l.lang = x.lang AND l.g = x.g[1:x.k] JOIN g r ON r.lang = x.lang AND r.g = x.g[x.k + 1:len(x.g)]),
        b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        u AS (SELECT lang, g, a, unnest(range(2, len(g))) AS m FROM c),
        v AS (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM u),
        z AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer FROM v GROUP BY lang, g[i:i + m - 1]),
        f AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN z ON z.lang = b.lang AND z.g = b.g
              WHERE z.longer IS NULL OR 100 * z.longer < 80 * b.a)
        SELECT f.lang, row_number() OVER (PARTITION BY f.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM f JOIN n ON n.lang = f.lang QUALIFY rank <= 2000""",
}
