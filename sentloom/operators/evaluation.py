"""Evaluation by correlation of similarities with a gold score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import pair_scores


def pearson(scores: DataFrame, a: str = "similarity", b: str = "gold") -> DataFrame:
    """One row: 100 times the correlation of two columns, without rows where one is missing."""
    both = scores.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")))
    return both.agg((F.corr(F.col(a).cast("double"), F.col(b).cast("double")) * 100).alias("pearson"))


def evaluate_halves(vectors: DataFrame, gold: DataFrame, pairs: int) -> DataFrame:
    """Correlation with gold (idx, gold) when sentence i is paired with sentence i + pairs of one corpus."""
    return pearson(pair_scores(vectors.where(F.col("idx") < pairs), vectors, pairs).join(gold, "idx"))
