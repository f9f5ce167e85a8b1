"""The corpus pipeline: five stages, each of which works on all that its predecessor kept."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from sentloom.llm import decontamination, exact_dedup, near_dedup, packing, quality
from sentloom.llm.exchange import forget, mark, shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A null or empty text is scored by the intercept; no row without a verdict."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null and empty texts are equal."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id; texts without words all stay."""
    return near_dedup.near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items; null and empty texts stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents left; a null or empty text is its end token."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_passages), ("packing", packed)]
#: No stage after the first can be stated in SQL without the classifier's verdicts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder, read again as the next one's docs. What a stage leaves there
    besides goes as soon as its result is written, and its result as soon as the next one's is."""
    home = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    fs = spark._jvm.org.apache.hadoop.fs
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out, since = f"{home}/{k}-{name}", mark()
        stage(spark, docs, sf_dir).write.parquet(out)
        forget(spark, since)
        if before:
            path = fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(out), out
    return docs
