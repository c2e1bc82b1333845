"""A pipeline over `documents`: quality, near duplicates, decontamination, PII, and byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.llm import _text as T
from lumenary.llm import bpe, decontaminate, jaccard_join, pii, quality_cnn


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, fitted on a bounded sample of the labelled ones, doesn't reject.

    Each row is judged by its own text, a null one as an empty one; columns of any name, repeated rows and null doc_ids
    stay as they are, and very long texts are read whole. An empty table, or one without labelled documents, fits a
    network that rejects nothing.
    """
    labels = T.table(spark, sf_dir, "labels").where(~T.held_out(F.col("doc_id"), 3, 1))
    name = T.fresh("score", docs.columns)
    scored = quality_cnn.score(docs, quality_cnn.train(docs, labels), docs.columns, name)
    return scored.where(F.col(name) >= 0.5).select(*T.columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group that links of 0.75 Jaccard similarity hold together.

    Null and blank texts all stay; of rows that are equal in doc_id and text one stays; very long texts count whole;
    columns may have any names; an empty table stays empty.
    """
    return jaccard_join.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows go or stay together.

    Very long texts are compared whole; an empty benchmark leaves all rows; columns may have any names.
    """
    return decontaminate.clean(docs, T.table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with PII in the text replaced; n_chars counts the new text (null for a null one).

    Empty texts stay empty, very long ones are treated whole, repeated rows stay and get equal texts, and an empty table
    stays empty.
    """
    out = pii.replace(docs, pii.QUERY_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*T.columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document: n_tokens and digests of the token ids and of the bytes decoded from them; none for null texts.

    An empty text has no tokens either; very long ones are encoded whole; repeated rows stay, with equal digests; an empty
    table gives an empty result.
    """
    import public_tokenizers as P

    return bpe.round_trip_digest(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def _stage(work):
    """A stage of this application, which has its workers take whole texts in small batches, also where its result is written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        T.small_batches(spark)
        return work(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_classifier", _stage(quality)),
    ("jaccard_join", _stage(near_duplicates)),
    ("decontamination", _stage(decontamination)),
    ("pii", _stage(surrogates)),
    ("byte_bpe", _stage(tokens)),
]

#: No SQL expresses the quality network or the tokenizer; tests/llm/test_pipeline.py holds it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, T.checkpoint(stage(spark, docs, sf_dir))
        T.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
