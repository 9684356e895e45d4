"""Cleans and encodes a corpus in stages; each stage works on all that the one before it kept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import columns
from quern.llm.bpe import encode_digests
from quern.llm.exact_dedup import drop_exact_duplicates
from quern.llm.langid import FEATURES, UNDETERMINED, Model, train, with_language
from quern.llm.mixing import mix
from quern.llm.simhash import drop_near_duplicates
from quern.sources.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language (null, or without a letter); a missing lang becomes the predicted one.

    Learns from all labelled texts. Ambiguous texts stay: mixed languages are no fault. Where nothing was learned,
    a missing lang stays missing. Very long texts are read whole; repeated rows stay; an empty table stays empty.
    """
    model = train(docs)
    learned = bool(model.languages)
    if not learned:  # a stand-in for any language, so that only texts without a letter are undetermined
        model = Model.from_counts({"": np.zeros(FEATURES)})
    prefix = "_" * (1 + max(map(len, docs.columns)))  # a name longer than any other is no other
    predicted = F.col(f"{prefix}lang_pred")
    found = with_language(docs, model, prefix=prefix).filter(predicted != UNDETERMINED)
    return (found.withColumn("lang", F.coalesce("lang", predicted)) if learned else found).select(*columns(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts: the one with the largest doc_id; null and empty texts are equal, a null doc_id is smallest.

    Of repeated rows one stays; very long texts are compared whole; an empty table stays empty.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near copies: the one with the smallest doc_id.

    Null and empty texts are near copies of each other; rows of one doc_id stay or go together; very long texts are
    fingerprinted whole; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's share says: some not at all, some twice.

    A null source is a source of its own, the last; null texts have no words; rows of one doc_id are taken alike; an
    empty table stays empty.
    """
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row that the mix took, repeated rows included.

    Null and empty texts have no tokens; very long ones are encoded whole; an empty table gives no rows.
    """
    import public_tokenizers

    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Language identification and SimHash fingerprints can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents; each writes what it keeps for the next. See the stages for nulls,
    empty and very long texts, repeated rows and empty tables; columns may have any further names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
