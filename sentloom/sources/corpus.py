"""Corpora as tables (idx, words) or (idx, text)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

TEXTS = T.StructType([T.StructField("idx", T.LongType(), False), T.StructField("text", T.StringType())])
WORDS = T.StructType([T.StructField("idx", T.LongType(), False), T.StructField("words", T.ArrayType(T.StringType()))])


def from_list(spark: SparkSession, *parts, index=None, split: bool = False) -> DataFrame:
    """Sentences held by the caller, numbered in order: lists, sets or arrays of str or of lists of str, one after another.

    index: a number for each sentence instead. split: strings become words.
    """
    for p in parts:
        if isinstance(p, (str, bytes)) or not hasattr(p, "__iter__"):
            raise TypeError("sentences come as list, set or array")
    items = [x for p in parts for x in p]
    if index is not None and len(index) != len(items):
        raise RuntimeError(f"{len(items)} sentences but {len(index)} indices")
    numbers = range(len(items)) if index is None else [int(i) for i in index]
    texts = all(isinstance(x, str) for x in items)
    rows = [(i, str(x) if texts else [str(w) for w in x]) for i, x in zip(numbers, items)]
    df = spark.createDataFrame(rows, TEXTS if texts else WORDS)
    return df.select("idx", words("text").alias("words")) if split and texts else df


def extend(corpus: DataFrame, more: DataFrame) -> DataFrame:
    """corpus and then more, whose indices go on after the largest of corpus."""
    after = corpus.agg(F.max("idx")).first()[0]
    return corpus.unionByName(more.withColumn("idx", F.col("idx") + F.lit(0 if after is None else after + 1)))


def without(corpus: DataFrame, idx: int) -> DataFrame:
    return corpus.where(F.col("idx") != idx)


def replaced(corpus: DataFrame, idx: int, value) -> DataFrame:
    name = "text" if "text" in corpus.columns else "words"
    new = F.lit(value) if name == "text" else F.array(*[F.lit(w) for w in value]).cast("array<string>")
    return corpus.withColumn(name, F.when(F.col("idx") == idx, new).otherwise(F.col(name)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, text): lines of the files at path, numbered from 0 in the order of file name and place.

    Spark cuts a file into partitions by bytes in order; each counts its lines, and the counts' running sum (one number a
    partition) says where each begins. A blank line is an empty sentence.
    """
    numbered = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    counts = numbered.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    from pyspark.sql import Window as W

    starts = counts.select("f", "b", "first", (F.sum("n").over(W.orderBy("f", "b")) - F.col("n")).alias("start"))  # a row for each split
    # ids of one split are consecutive from its first
    return numbered.join(starts, ["f", "b"]).select((F.col("start") + F.col("m") - F.col("first")).cast("long").alias("idx"), "text")


def line_at(corpus: DataFrame, i: int) -> str:
    """The text of one line without trailing white space; a negative i counts from the end."""
    if i < 0:
        last = corpus.agg(F.max("idx")).first()[0]
        i += 0 if last is None else last + 1
    row = corpus.where(F.col("idx") == i).select(F.regexp_replace("text", "[\\s\\u00a0]+$", "").alias("t")).first()
    if row is None:
        raise IndexError(i)
    return row["t"]


def sentence_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(row, score, sentence1, sentence2) of a tab-separated similarity benchmark: score in field 4 (from 0), sentences in 5 and 6."""
    table = lines(spark, path)
    part = F.split("text", "\t")
    return table.select(F.col("idx").alias("row"), F.try_element_at(part, F.lit(5)).cast("double").alias("score"), F.try_element_at(part, F.lit(6)).alias("sentence1"), F.try_element_at(part, F.lit(7)).alias("sentence2"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; a local one only where none is named and all runs on one machine, as in tests."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        import tempfile

        home = os.path.join(tempfile.gettempdir(), "sentloom")
    return f"{home}/{name}-{uuid.uuid4().hex}"
