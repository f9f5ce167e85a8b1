"""Vector arithmetic on array columns, accumulated in double: in the JVM, or in Arrow where a row's elements share what is dear to compute."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1.1920928955078125e-07  # of single precision


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """a / |a|; every component of a zero vector becomes NaN."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, F.try_divide(x.cast("double"), n)).otherwise(F.lit(float("nan"))))


def cosine(a: Column, b: Column) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > 0, F.try_divide(dot(a, b), d)).otherwise(F.lit(float("nan")))


def literal(values) -> Column:
    return F.lit([float(x) for x in values])


def rowwise(how):
    """A function of a matrix (rows x numbers, double) to one of the same size, as a function of array columns: a batch is one step, in Arrow.
    A lambda over arrays would evaluate what all elements of a row share once for each of them. Null rows stay null."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        have = v.drop_null()
        if not len(have):
            return v.cast(pa.list_(pa.float64()))
        x = how(have.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(have), -1))
        width = x.shape[1]
        if v.null_count == 0:
            offsets = pa.array(np.arange(len(v) + 1) * width, pa.int32())
        else:
            ends = np.concatenate([[0], np.cumsum(v.is_valid().to_numpy(zero_copy_only=False) * width)])
            offsets = pa.array(ends, pa.int32(), mask=np.append(v.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))

    return run


def removed(v: Column, components, weights=None) -> Column:
    """v without its projections on the components (rows). A weight enters squared."""
    c = np.asarray(components, float)
    w = np.ones(len(c)) if weights is None else np.asarray(weights, float) ** 2
    return rowwise(lambda x: x - (x @ c.T * w) @ c)(v)


def _unit_rows(x):
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n > 0, n, np.nan)[:, None]


def unit_rows(v: Column) -> Column:
    """Like unit(), a batch at a time."""
    return rowwise(_unit_rows)(v)
