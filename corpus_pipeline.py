"""Corpus pipeline: quality, near-duplicates, decontamination, privacy, packing.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame`` and works on all rows its
predecessor kept; its result is written as Parquet to the shared folder and
read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sensorspark.llm import decontaminate, knn_quality, packing, pii_crf, simhash
from sensorspark.llm.common import read_table, scratch
from sensorspark.session import checkpoint_dir, remove_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote does not reject."""
    return knn_quality.keep_good(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii_crf.redact(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 512 to 4096 tokens."""
    return packing.best_fit(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark_leaks), ("privacy", privacy), ("packing", best_fit)]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's working tables, and the table
    that it read, are deleted once its result is stored."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark, f"pipeline-{name}"):
            out = stage(spark, docs, sf_dir)
            path = f"{checkpoint_dir(spark)}/llm/pipeline-{name}-{uuid.uuid4().hex}"
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove_path(spark, last)
        last = path
    return docs
