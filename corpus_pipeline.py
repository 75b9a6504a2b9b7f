"""The corpus pipeline: clean documents, without copies, mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; between stages the documents are written as Parquet and read
again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import exact_dedup, mixing, near_dedup, quality, sentencepieces
from fieldbook.llm.common import documents_of, fresh
from fieldbook.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 10), fitted on the labels, rejects go.

    A null or empty text is scored like any other, whole texts of any length are
    measured, repeated rows fare alike, a score of exactly a half stays, an empty
    table stays empty, and columns of any name are kept.
    """
    labels = quality.quality_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.drop_rejected(docs, documents_of(docs, "doc_id", "text"), labels)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal without white space (operator 9) one stays: the longest, then the least doc_id.

    Null counts as empty, so of null, empty and blank texts one stays in all; of
    rows repeated whole one stays. Whole texts are compared, an empty table stays
    empty, and columns of any name are kept.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates by b-bit MinHash (operator 5; five words, similarity 0.8) one of each group stays, the least doc_id.

    Texts that are null or without words are linked with nothing and stay; shorter
    texts are one shingle, and long ones are read whole. Of repeated rows one
    stays, an empty table stays empty, and columns of any name are kept.
    """
    return near_dedup.drop_near_copies(docs, words=5, similarity=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target weight asks (operator 1), repeats as rows.

    A null source is a source, the last one. Texts that are null or without words
    have size 0 and come as often as every document of their source does at least;
    repeated rows are documents of their own. An empty table stays empty, and
    columns of any name are kept.
    """
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids and their number beside each document (operator 7), in columns ``ids`` and ``n_tokens``.

    Their names are lengthened by ``_`` where there are such columns. A null text
    counts as empty and has no ids; texts are encoded whole, repeated rows alike,
    and an empty table stays empty.
    """
    ids = fresh("ids", docs.columns)
    encoded = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), into=ids)
    return encoded.withColumn(fresh("n_tokens", encoded.columns), F.size(ids))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("sentencepiece encoding", encode_pieces),
]

#: A trained classifier, MinHash and random rounding are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
