"""Similarity queries over sentence vectors (idx, vector)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.arrays import cosine, dot, literal, norm, unit
from .linalg import normalised
from .ordering import numbered

QUERY_BLOCK = 1024  # queries that are set against a batch of rows in one product
QUERY_BYTES = 32 << 20  # of queries that go to every task at once


def score(vector: Column, unit_query: Column) -> Column:
    """Dot product of the row's unit vector with a unit vector; NaN for a zero row."""
    n = norm(vector)
    return F.when(n > 0, F.try_divide(dot(vector, unit_query), n)).otherwise(F.lit(float("nan")))


@dataclass(frozen=True)
class SentenceVectors:
    vectors: DataFrame

    def __len__(self) -> int:
        return self.vectors.count()

    def __contains__(self, idx: int) -> bool:
        if not isinstance(idx, int):
            raise KeyError(idx)
        return not self.vectors.where(F.col("idx") == idx).isEmpty()

    def __getitem__(self, idx: int | list[int]) -> np.ndarray:
        if isinstance(idx, int):
            return self.get_vector(idx)
        return np.stack([np.array(r["vector"]) for r in self.lookup(idx).orderBy("position").collect()])

    def lookup(self, ids: Iterable[int]) -> DataFrame:
        """(position, idx, vector) of the asked indices in their order; the list is the caller's own, so it is sent along."""
        asked = self.vectors.sparkSession.createDataFrame(list(enumerate(int(i) for i in ids)), "position int, idx long")
        return asked.join(self.vectors.where(F.col("idx").isin([int(i) for i in ids])), "idx").select("position", "idx", "vector")

    def get_vector(self, idx: int, use_norm: bool = False) -> np.ndarray:
        row = self.vectors.where(F.col("idx") == int(idx)).select((unit(F.col("vector")) if use_norm else F.col("vector")).alias("v")).first()
        if row is None:
            raise KeyError(f"no sentence {idx}")
        out = np.array(row["v"])
        out.flags.writeable = False
        return out

    def normalised(self) -> DataFrame:
        return normalised(self.vectors)

    def similarity(self, a: int, b: int) -> float:
        x, y = self.get_vector(a), self.get_vector(b)
        d = np.linalg.norm(x) * np.linalg.norm(y)
        return float(x @ y / d) if d else float("nan")

    def distance(self, a: int, b: int) -> float:
        return 1 - self.similarity(a, b)

    def most_similar(self, positive=(), negative=(), indexable: DataFrame | None = None, topn: int | None = 10, restrict_size=None) -> DataFrame:
        """(idx, similarity) of the rows nearest to the signed mean of the inputs, ties by idx.

        Inputs: one or several of index, vector, or (either, weight). restrict_size: n for rows below n, (lo, hi) for a range. Inputs given by index are left
        out, unless topn is none or 0: then all rows of the range come. indexable: a table (idx, ...) whose columns are added to the winners.
        """
        if indexable is not None and not (isinstance(indexable, DataFrame) and "idx" in indexable.columns):
            raise RuntimeError("indexable must be a DataFrame with a column idx")
        parts = [(x, s * w) for side, s in ((positive, 1.0), (negative, -1.0)) for x, w in _weighted(side)]
        if not parts:
            raise ValueError("no input")
        given = [int(x) for x, _ in parts if not isinstance(x, np.ndarray)]
        found = {r["idx"]: np.array(r["vector"]) for r in self.lookup(set(given)).collect()} if given else {}
        total = np.zeros(0)
        for x, w in parts:
            if not isinstance(x, np.ndarray):
                if int(x) not in found:
                    raise KeyError(f"no sentence {x}")
                v = found[int(x)]
                x = v / np.linalg.norm(v)
            total = w * x if not len(total) else total + w * x
        total = total / len(parts)
        return nearest(self.vectors, literal(total / np.linalg.norm(total)), given, topn, restrict_size, indexable)

    def similar_by_vector(self, vector, **how) -> DataFrame:
        return self.most_similar(positive=np.asarray(vector, float), **how)

    def similar_by_word(self, word: str, wv, **how) -> DataFrame:
        row = wv.vocab.where(F.col("word") == word).select("vector").first()
        if row is None:
            raise KeyError(word)
        return self.similar_by_vector(row["vector"], **how)

    def similar_by_sentence(self, sentence: list[str], model, **how) -> DataFrame:
        if not hasattr(model, "transform"):
            raise RuntimeError("the model can't embed sentences")
        one = self.vectors.sparkSession.createDataFrame([(0, list(sentence))], "idx long, words array<string>")
        return self.similar_by_vector(model.transform(one).first()["vector"], **how)

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SentenceVectors:
        return SentenceVectors(spark.read.parquet(path))


def _weighted(side) -> list[tuple]:
    """A side's inputs with their weights: an index, vector or pair alone, or a list of them."""
    single = lambda x: isinstance(x, (int, np.integer)) or isinstance(x, np.ndarray) and x.ndim == 1
    if single(side):
        return [(side, 1.0)]
    out = []
    for x in side:
        if isinstance(x, tuple):
            if len(x) != 2 or not single(x[0]):
                raise ValueError("an input is an index or a vector, with or without a weight")
            out.append((x[0], float(x[1])))
        elif single(x):
            out.append((x, 1.0))
        else:
            raise TypeError(type(x).__name__)
    return out


def in_range(vectors: DataFrame, restrict_size) -> DataFrame:
    if restrict_size is None:
        return vectors
    lo, hi = restrict_size if isinstance(restrict_size, tuple) else (0, restrict_size)
    return vectors.where((F.col("idx") >= lo) & (F.col("idx") < hi))


def nearest(vectors: DataFrame, unit_query: Column, given=(), topn: int | None = 10, restrict_size=None, indexable: DataFrame | None = None) -> DataFrame:
    scored = in_range(vectors, restrict_size).select("idx", score(F.col("vector"), unit_query).alias("similarity"))
    scored = scored.where(~F.isnan("similarity"))
    if topn:
        if given:
            scored = scored.where(~F.col("idx").isin(list(given)))
        scored = scored.orderBy(F.desc("similarity"), "idx").limit(topn)
    return scored if indexable is None else scored.join(indexable, "idx")


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(qid, idx, similarity, rank): of each row of queries (qid, vector) the k nearest rows, ties by idx. Rows that repeat a qid, or have none, are each a
    query of their own. Queries go to every task as matrices of at most QUERY_BYTES; one scan of vectors serves all of a matrix, and a task keeps k rows
    of a batch for each; the rest is a window over these."""
    import pyarrow as pa

    order = numbered(queries.select("qid", F.col("vector").cast("array<double>").alias("vector")), "_q", F.col("qid"), F.col("vector"))
    size, n = order.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    block = max(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, size or 1)))
    out = None
    for begin in range(0, n, block):
        some = order.where((F.col("_q") >= begin) & (F.col("_q") < begin + block)).select("_q", "vector").toArrow()
        ids = some.column(0).to_numpy()
        q = some.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        with np.errstate(all="ignore"):
            q = q / np.linalg.norm(q, axis=1)[:, None]
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            ids, q = shared.value
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                idx = batch.column(0).to_numpy()
                n = np.linalg.norm(x, axis=1)
                for a in range(0, len(ids), QUERY_BLOCK):
                    with np.errstate(all="ignore"):
                        sim = (q[a : a + QUERY_BLOCK] @ x.T) / n
                    sim[~np.isfinite(sim)] = -np.inf
                    row, col = _best(sim, idx, k)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + row]), pa.array(idx[col]), pa.array(sim[row, col])], names=["_q", "idx", "similarity"])

        part = vectors.select(F.col("idx").cast("long").alias("idx"), "vector").mapInArrow(run, "_q long, idx long, similarity double")
        out = part if out is None else out.unionByName(part)
    kind = dict(queries.dtypes)["qid"]
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"qid {kind}, idx long, similarity double, rank int")
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("similarity"), "idx"))
    best = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(order.select("_q", "qid"), "_q").select("qid", "idx", "similarity", "rank")


def _best(sim: np.ndarray, idx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest finite values, ties by idx."""
    if sim.shape[1] > k:
        least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
        ok = (sim >= least[:, None]) & np.isfinite(sim)
        for r in np.flatnonzero(ok.sum(axis=1) > k):  # ties with the last one
            at = np.flatnonzero(ok[r])
            ok[r, at[np.lexsort((idx[at], -sim[r, at]))[k:]]] = False
    else:
        ok = np.isfinite(sim)
    return np.nonzero(ok)


def pair_scores(a: DataFrame, b: DataFrame, offset: int = 0) -> DataFrame:
    """(idx, similarity, distance) of row idx of a with row idx + offset of b."""
    right = b.select((F.col("idx") - offset).alias("idx"), F.col("vector").alias("_other"))
    s = a.join(right, "idx").select("idx", cosine(F.col("vector"), F.col("_other")).alias("similarity"))
    return s.withColumn("distance", 1 - F.col("similarity"))
