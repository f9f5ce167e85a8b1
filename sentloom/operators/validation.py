"""Checks and statistics of inputs. All rows are looked at, in one aggregate."""

from __future__ import annotations

import math
import os
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    total_sentences: int
    total_words: int
    average_length: int
    empty_sentences: int
    max_index: int


def check_schema(corpus) -> None:
    if not isinstance(corpus, DataFrame):
        raise TypeError("sentences come as a DataFrame (idx, words)")
    kinds = dict(corpus.dtypes)
    if kinds.get("words") != "array<string>":
        raise TypeError("words must be an array of strings")
    if kinds.get("idx") not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("idx must be an integer")


def _statistics() -> list:
    n = F.coalesce(F.size("words"), F.lit(0))
    n = F.when(n > 0, n).otherwise(0)  # the size of a null is -1 in some settings
    return [
        F.count(F.lit(1)).alias("total_sentences"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_words"),
        F.coalesce(F.sum(F.when(n == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("empty_sentences"),
        F.coalesce(F.max("idx") + 1, F.lit(0)).cast("long").alias("max_index"),
    ]


def scan_statistics(corpus: DataFrame) -> DataFrame:
    """Statistics of all rows as one row of a DataFrame, unchecked."""
    return corpus.agg(*_statistics()).withColumn("average_length", F.coalesce(F.floor(F.try_divide("total_words", "total_sentences")), F.lit(0)).cast("long"))


def scan(corpus: DataFrame, dense: bool = True) -> Scan:
    """Checked statistics of all rows, in one pass. dense: an index must be below the number of rows, as rows of a matrix are."""
    check_schema(corpus)
    got = corpus.agg(*_statistics(), F.min("idx").alias("lowest"), F.coalesce(F.sum(F.col("idx").isNull().cast("int")), F.lit(0)).alias("nulls")).first().asDict()
    lowest, nulls = got.pop("lowest"), got.pop("nulls")
    if nulls:
        raise TypeError("an index is null")
    if lowest is not None and lowest < 0:
        raise ValueError("an index is negative")
    if not got["total_sentences"]:
        raise ValueError("no sentences")
    out = Scan(**got, average_length=got["total_words"] // got["total_sentences"])
    if dense and out.max_index > out.total_sentences:
        raise RuntimeError(f"the largest index is {out.max_index - 1}, but there are {out.total_sentences} sentences")
    return out


def check_result(sentences: int, words: int) -> None:
    if not sentences or not words:
        raise ValueError("no sentence has a word with a vector")


def check_weights(vocab: DataFrame, low: float | None, high: float | None) -> None:
    got = vocab.agg(F.min("weight"), F.max("weight"), F.sum((F.isnan("weight") | F.col("weight").isNull()).cast("int"))).first()
    if got[2] or (low is not None and got[0] < low) or (high is not None and got[1] > high) or math.isinf(got[1]):
        raise ValueError(f"word weights from {got[0]} to {got[1]}")


def estimate_memory(max_index: int, words: int, size: int, bucket: int | None = None) -> dict[str, int]:
    """Bytes of a single-precision model in one process: weights, word vectors, sentence vectors, and sub-words."""
    out = {"Word Weights": 4 * words, "Word Vectors": 4 * words * size, "Sentence Vectors": 4 * max_index * size}
    if bucket is not None:
        out |= {"Vocab Vectors": 4 * words * size, "Ngram Vectors": 4 * bucket * size}
    out["Total"] = sum(out.values())
    return out


def available_memory(spark) -> int:
    """Bytes that executors may use together: their number times spark.executor.memory, or this machine's memory where all runs on it."""
    if spark.sparkContext.master.startswith("local"):
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    conf = spark.sparkContext._jsc.sc().conf()
    each = conf.getSizeAsBytes("spark.executor.memory", "1g")
    return each * max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)


def warn_memory(total: int, spark, share: float = 0.95) -> None:
    """Warns where a model's estimate is above that share of the memory there is; Spark then spills."""
    there = available_memory(spark)
    if total > share * there:
        warnings.warn(f"the model needs about {total / 2**30:.2f} GB; there are {there / 2**30:.2f} GB", stacklevel=3)
