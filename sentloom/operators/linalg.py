"""Principal components of sentence vectors and their removal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import removed, unit_rows


@dataclass(frozen=True)
class Components:
    """Singular values and rows of components; weights, if any, enter their removal squared."""

    sigma: np.ndarray
    rows: np.ndarray
    weights: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.sigma)


def gramian(vectors: DataFrame, column: str = "vector") -> np.ndarray:
    """X'X of uncentred rows. Each task makes one d x d sum, and these are added up on the executors."""

    def run(batches):
        total = None
        for batch in batches:
            flat = batch.column(0).drop_null()
            if len(flat):
                x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            rows = np.arange(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * len(total), pa.int32()), pa.array(total.ravel()))], names=["i", "row"])

    from .averaging import _sum_of

    parts = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "i int, row array<double>")
    got = parts.groupBy("i").agg(_sum_of("row").alias("row")).toArrow().sort_by("i")  # d rows
    return np.array(got.column("row").to_pylist()) if got.num_rows else np.zeros((0, 0))


def principal_components(vectors: DataFrame, components: int = 1, column: str = "vector", sample: float | None = None, seed: int = 42) -> Components:
    """The first right singular vectors of uncentred rows, from X'X; the sign makes a component's largest entry positive. sample: a share of rows to use."""
    if sample is not None and sample < 1:
        vectors = vectors.sample(sample, seed)
    g = gramian(vectors, column)
    if components < 1 or not len(g):
        return Components(np.empty(0), np.empty((0, len(g))))
    values, axes = np.linalg.eigh(g)
    order = np.argsort(-values)[: min(components, len(values))]
    rows = axes[:, order].T
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    return Components(np.sqrt(np.clip(values[order], 0, None)), rows)


def remove_components(vectors: DataFrame, components: Components, column: str = "vector") -> DataFrame:
    if not len(components):
        return vectors
    return vectors.withColumn(column, removed(F.col(column), components.rows, components.weights))


def normalised(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Rows of length one; a zero row becomes NaN."""
    return vectors.withColumn(column, unit_rows(F.col(column)))
