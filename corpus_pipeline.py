"""A corpus, cleaned step by step: each stage takes the documents that the one before it kept.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. The result of a stage is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm import exact, language, mixing, pieces, similar
from keepwell.llm.store import shared_folder, stored, table

#: A language counts as told from this score on; texts without letters have none.
LEAST_SCORE = 0.4
#: Wanted shares of the tokens, and tokens wanted over tokens there.
TARGETS, BUDGET = {"good": 0.93, "poor": 0.05, "toxic": 0.02}, 1.0
SEED = 17


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing label is filled in."""
    return language.keep_identified(docs, least=LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every group linked by five-word shingles of Jaccard 0.8 or more."""
    return similar.drop_near_duplicates(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says."""
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labels, TARGETS, BUDGET)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, pieces, n_pieces of every row, and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    signed = docs.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    back = pieces.encode(signed, model, keep=("doc_id", "source", "lang", "text_hash"), seed=SEED, back=True)
    return back.select("doc_id", "source", "lang", "pieces", F.size("pieces").alias("n_pieces"),
                       (F.sha2("decoded", 256) == F.col("text_hash")).alias("lossless"))


STAGES = [("language ID", identify_language), ("exact dedup", exact_dedup), ("near-dedup", near_dedup),
          ("mixing to target weights", mix_domains), ("SentencePiece encoding", encode_pieces)]
ORACLE_SQL = None  # trained models and fingerprints; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
