"""Vocabularies, frequencies and the weights that come from them."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.arrays import EPS
from .ordering import numbered

DOMAIN = 2**31 - 1
ONE_TASK = 1 << 18  # words that one task may number


def build_vocabulary(corpus: DataFrame, most: int | None = None) -> DataFrame:
    """(word, count, index) of (idx, words): by descending count, then word. most: only so many of the first."""
    counts = corpus.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    if most is None or most > ONE_TASK:
        every = numbered(counts, "index", F.desc("count"), F.col("word")).withColumn("index", F.col("index").cast("int"))
        return every if most is None else every.where(F.col("index") < most)
    counts = counts.orderBy(F.desc("count"), "word").limit(most)  # the window below then sees `most` rows
    return counts.withColumn("index", (F.row_number().over(W.orderBy(F.desc("count"), "word")) - 1).cast("int"))


def induced_counts(vocab: DataFrame, frequencies: DataFrame, domain: int = DOMAIN, missing: float = 1e-8) -> DataFrame:
    """vocab with counts from a table (word, freq) of a language's frequencies; a word it lacks has frequency `missing`."""
    freq = F.coalesce(F.col("freq"), F.lit(missing))
    return vocab.drop("count").join(frequencies.select("word", "freq"), "word", "left").withColumn("count", F.floor(freq * domain).cast("long")).drop("freq")


def language_frequencies(table: DataFrame, language: str) -> DataFrame:
    """(word, freq) of one language, from a table (lang, word, freq). A language that it lacks is an error."""
    found = table.where(F.col("lang") == language).select("word", "freq")
    if found.isEmpty():
        known = [r["lang"] for r in table.select("lang").distinct().orderBy("lang").limit(100).collect()]
        raise ValueError(f"no frequencies of {language!r}; there are {', '.join(map(str, known))}")
    return found


def _totals(vocab: DataFrame) -> tuple[int, int]:
    got = vocab.agg(F.sum("count").alias("s"), F.count(F.lit(1)).alias("n"), F.min("count").alias("lo")).first()
    if got["lo"] is not None and got["lo"] < 0:
        raise ValueError("a word has a negative count")
    if not got["s"]:
        raise RuntimeError("words have no counts")
    if got["s"] == got["n"]:
        warnings.warn("every word has a count of 1: frequencies are missing, and weights will be alike", stacklevel=3)
    return int(got["s"]), int(got["n"])


def uniform_weights(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn("weight", F.lit(1.0))


def sif_weights(vocab: DataFrame, alpha: float = 1e-3) -> DataFrame:
    """weight = alpha / (alpha + p), p being the word's share of all counts."""
    if not alpha > 0:
        raise ValueError("alpha must be above 0")
    total, _ = _totals(vocab)
    return vocab.withColumn("weight", F.lit(float(alpha)) / (F.lit(float(alpha)) + F.col("count") / F.lit(float(total))))


def usif_weights(vocab: DataFrame, length: float) -> DataFrame:
    """weight = a / (a / 2 + p), a following from the sentences' length and the share of words above a threshold."""
    if not length > 0:
        raise ValueError("length must be above 0")
    total, n = _totals(vocab)
    p = F.col("count") / F.lit(float(total))
    threshold = 1 - (1 - 1 / n) ** length
    above = vocab.agg(F.sum(F.when(p > threshold, 1).otherwise(0))).first()[0]
    alpha = above / n
    a = (1 - alpha) / (alpha * n / 2 + EPS)
    return vocab.withColumn("weight", F.lit(a) / (F.lit(a / 2) + p))
