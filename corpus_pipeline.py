"""The corpus pipeline: a corpus of documents to token ids, in five stages, each by one of the training-data operators.

All stages but the last return the columns of docs, whatever others it has and whatever they are called. A stage's rows
go to Python in small batches, and the session keeps that setting, as the caller runs what a stage returns. Null texts count as empty
ones, texts are read whole however long, an empty table gives an empty table; what a stage makes of ties and repeated rows
is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import language_profiles, mixing, near_copies, piece_matching, quality_compression
from vellum.llm.common import crc_fold, keep_batches_small, materialize

#: A document is rejected below this probability of being good: only what is clearly bad goes.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (3): documents whose score is below LEAST_QUALITY go. The model learns from the labels beside the
    documents, a third held out; without labels of both classes every document stays. Null and empty texts have the score of
    a text that neither dictionary knows better. Repeated rows are scored alike, so they stay or go together; of labels for the same id each
    counts. Null ids and null labels teach nothing."""
    keep_batches_small(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold(F.col("doc_id")) != 1)
    model = quality_compression.train(docs, labels)
    scored = quality_compression.with_score(docs, model, "__vellum_score")
    return scored.where(F.col("__vellum_score") >= LEAST_QUALITY).drop("__vellum_score")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (5): documents without a letter go, null and empty ones with them, and those whose score lies below the floor
    of the labelled texts, which are in no language that has a profile. Without a labelled text all go. Repeated rows stay or go
    together; of languages at the same distance the first in the alphabet is taken, which decides nothing here."""
    keep_batches_small(spark)
    profiles, least = language_profiles.train_with_floor(docs.where(crc_fold(F.col("doc_id")) != 1))
    found = language_profiles.with_language(docs, profiles, "__vellum_lang", "__vellum_score")
    known = (F.col("__vellum_lang") != language_profiles.UNKNOWN) & (F.col("__vellum_score") >= least)
    return found.where(known).drop("__vellum_lang", "__vellum_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (1): of each group of exact and near copies the document with the least id stays, null ids after all
    others, of equal ids the one with the least digest of its text; of rows that agree in id and text one. Texts without words,
    null ones too, are one group."""
    keep_batches_small(spark)
    return near_copies.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (8): documents drawn with the production targets. Repeated ids are taken or left
    together; texts without words are not taken; null sources and languages count among the others."""
    return mixing.sample(docs, mixing.PRODUCTION)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding (6): (doc_id, ids, n_tokens, round_trip), a row for each document. Null and empty texts have no ids;
    repeated rows are encoded alike; of pieces with equal scores the leftmost is joined first."""
    keep_batches_small(spark)
    return piece_matching.encode_documents(docs, piece_matching.Pieces.load())


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL expresses none of the stages but the mixture's sums; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared scratch folder and read again by the next. Nulls, ties, long
    texts, repeated rows, empty tables and other columns: as the stages say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
