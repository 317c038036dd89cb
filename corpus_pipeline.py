"""The corpus pipeline: quality, exact copies, near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before
kept; its result is written as Parquet and read again. All stages but the last return the
columns of ``documents``. The mix returns a document as many times as it is taken, and
each of these is packed. SQL cannot express the fitted classifier of the first stage nor
the packing, so ORACLE_SQL is None and the stages are tested against brute-force versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clinicframe.llm import golomb_dedup, ngram_join, pattern_packing, quality_classifier, weighted_mix
from clinicframe.llm.queries import table, tokenizer_file
from clinicframe.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return golomb_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_first(docs, n=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    return weighted_mix.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pattern_packing.pack(docs, tokenizer_file())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
