"""Op 7. Quality by naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the classes' log-count ratios; a linear model with hinge loss is fitted to
them by dual coordinate descent. The n-grams are those of word shapes (case, ending, repetition, length), of words
and of a word's first and last bytes, so that a text's form counts as well as its vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .kernel import LOWER, U, Words, chunks, column, mix, prefix, span

BITS = 18
MAX_ROWS = 12_000  # labelled rows that a fit may take: with at most one feature for each hash this bounds the driver's memory


def _shape(w: Words) -> np.ndarray:
    """A small number for each word: length (capped), case of its ends, kind of its last two bytes, whether it repeats the one before."""
    kind = np.zeros(256, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 4
    d, s, e = w.data, w.start, w.end - 1
    size = np.minimum(w.end - w.start, 12) // 3
    same = np.zeros(len(s), np.int64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return ((((kind[d[s]] * 5 + kind[d[np.minimum(s + 1, e)]]) * 5 + kind[d[e]]) * 5 + kind[d[np.maximum(e - 1, s)]]) * 5 + size) * 2 + same


def features(data: np.ndarray, offsets: np.ndarray, i: int, j: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted by text: distinct hashed n-grams, their cuts) of texts i..j."""
    w = Words(data, offsets, i, j)
    if not len(w):
        return np.empty(0, np.int64), np.zeros(j - i + 1, np.int64)
    shape = mix(_shape(w).astype(U))
    lower = span(prefix(LOWER[w.data]), w.start, w.end)
    tail = span(prefix(LOWER[w.data]), np.maximum(w.start, w.end - 3), w.end)
    doc, out = [w.doc] * 3, [shape, lower ^ U(11), tail ^ U(13)]
    for k in (2, 3):
        h = shape[: len(shape) - k + 1].copy()
        for m in range(1, k):
            h = mix(h * U(31) + shape[m : len(shape) - k + 1 + m])
        ok = w.doc[k - 1 :] == w.doc[: len(w) - k + 1]
        doc.append(w.doc[: len(w) - k + 1][ok])
        out.append(h[ok])
    pair = mix(lower[:-1] * U(31) + lower[1:])
    ok = w.doc[1:] == w.doc[:-1]
    doc.append(w.doc[:-1][ok])
    out.append(pair[ok])
    code = np.concatenate([(d.astype(np.int64) << bits) | (h >> U(64 - bits)).astype(np.int64) for d, h in zip(doc, out)])
    if (j - i) << bits <= 1 << 27:  # a table of all (text, n-gram) is faster than sorting
        seen = np.zeros((j - i) << bits, bool)
        seen[code] = True
        code = np.flatnonzero(seen)
    else:
        code = np.unique(code)
    return code & ((1 << bits) - 1), np.searchsorted(code, np.arange(j - i + 1) << bits)


@dataclass
class Quality:
    """weights: of each hashed n-gram, its ratio times its coefficient; a score is the logistic of scale * margin + shift."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    bits: int

    def margins(self, f: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[f])])
        size = np.maximum(1, np.diff(cuts))
        return (sums[cuts[1:]] - sums[cuts[:-1]]) / np.sqrt(size) + self.bias

    def scores(self, f: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(f, cuts) + self.shift, -60, 60)))


def ratios(f: np.ndarray, cuts: np.ndarray, label: np.ndarray, rows: np.ndarray, bits: int, alpha: float = 1.0) -> np.ndarray:
    """Log-count ratio of each hashed n-gram: in how many rows of class 1 against class 0, smoothed by alpha and over each class's sum."""
    counts = [np.full(1 << bits, alpha), np.full(1 << bits, alpha)]
    for x in rows:
        counts[label[x]][f[cuts[x] : cuts[x + 1]]] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(f: np.ndarray, cuts: np.ndarray, label: np.ndarray, rows: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int = 5, least: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights of the scaled indicators, bias, dual variables) of the linear model with hinge loss: coordinates in random order, each to its optimum,
    until a round's largest step is below `least`. A row's indicators are ratios over the root of its number of n-grams; the bias is
    an indicator of every row. The smaller class 0 gets a larger c, by the classes' sizes."""
    n = len(label)
    y = np.where(label > 0, 1.0, -1.0)
    upper = np.where(label > 0, c, c * max(1.0, (label[rows] > 0).sum() / max(1, (label[rows] == 0).sum())))
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(n)
    size = np.sqrt(np.maximum(1, np.diff(cuts)))
    square = np.zeros(n)
    for x in rows.tolist():
        v = ratio[f[cuts[x] : cuts[x + 1]]] / size[x]
        square[x] = v @ v + 1
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for x in rnd.permutation(rows).tolist():
            at = f[cuts[x] : cuts[x + 1]]
            v = ratio[at] / size[x]
            g = y[x] * (float(w[at] @ v) + bias) - 1
            new = min(max(dual[x] - g / square[x], 0.0), upper[x])
            step = (new - dual[x]) * y[x]
            if step:
                w[at] += step * v
                bias += step
                dual[x] = new
                most = max(most, abs(step))
        if most < least:
            break
    return w, bias, dual


def fit(f: np.ndarray, cuts: np.ndarray, label: np.ndarray, bits: int = BITS, c: float = 1.0, epochs: int = 12, alpha: float = 1.0, seed: int = 5) -> Quality:
    """Fits ratios, the hinge-loss model and the logistic of its margins (on a fifth that the model for it hasn't seen)."""
    n = len(label)
    if not n or label.min() == label.max():  # one class or none: its share is the score
        p = (label.sum() + 0.5) / (n + 1)
        return Quality(np.zeros(1 << bits), 0.0, 1.0, float(np.log(p / (1 - p))), bits)

    def descend(rows: np.ndarray) -> tuple[np.ndarray, float]:
        ratio = ratios(f, cuts, label, rows, bits, alpha)
        w, bias, _ = dual_descent(f, cuts, label, rows, ratio, c, epochs, seed)
        return w * ratio, bias

    order = np.random.default_rng(seed).permutation(n)
    fifth = order[: n // 5]
    scale, shift = 1.0, 0.0
    if len(fifth) >= 20 and 0 < label[fifth].sum() < len(fifth) and 0 < label[order[n // 5 :]].sum() < n - n // 5:
        w, bias = descend(order[n // 5 :])
        part = Quality(w, bias, 1, 0, bits)
        m = part.margins(np.concatenate([f[cuts[x] : cuts[x + 1]] for x in fifth]), np.concatenate([[0], np.cumsum([cuts[x + 1] - cuts[x] for x in fifth])]))
        t = np.where(label[fifth] > 0, (label[fifth].sum() + 1) / (label[fifth].sum() + 2), 1 / ((label[fifth] == 0).sum() + 2))
        for _ in range(100):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(scale * m + shift, -60, 60)))
            g = np.array([((p - t) * m).sum() + 1e-3 * scale, (p - t).sum()])
            v = p * (1 - p) + 1e-9
            h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
            d = np.linalg.solve(h, g)
            scale, shift = scale - d[0], shift - d[1]
            if np.abs(d).max() < 1e-7:
                break
    w, bias = descend(order)
    return Quality(w, bias, float(scale), float(shift), bits)


def held_out(folds: int):
    return (F.pmod(F.crc32(F.coalesce(F.col(X.DOC).cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0).alias("held_out")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, folds: int = 5) -> Quality:
    """Learns from at most max_rows labelled rows outside the held-out fold, those with the least hashes of doc_id."""
    known = labels.select(F.col(X.DOC).cast("long").alias(X.DOC), F.col("quality").cast("int").alias("quality")).where(f"{X.DOC} is not null and quality in (0, 1)")
    known = known.where(~held_out(folds)).groupBy(X.DOC).agg(F.max("quality").alias("quality"))
    chosen = X.cut(known.orderBy(F.xxhash64(X.DOC), X.DOC).limit(max_rows))  # at most max_rows rows, so it may be broadcast
    texts = X.corpus(docs).join(F.broadcast(chosen), X.DOC)

    def run(batches):
        for batch in batches:
            data, offsets = column(batch.column(1))
            for i, j in chunks(offsets):
                f, cuts = features(data, offsets, i, j, bits)
                blobs = [f[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(blobs, pa.binary())], names=["doc_id", "quality", "f"])

    got = texts.select(X.DOC, X.TEXT, "quality").mapInArrow(run, "doc_id long, quality int, f binary").orderBy(X.DOC).limit(max_rows).toArrow()
    label = got.column("quality").to_numpy().astype(np.int64)
    blobs = got.column("f").cast(pa.large_binary()).combine_chunks()
    del got
    _, ends, body = blobs.buffers() if len(blobs) else (None, None, None)
    cuts = np.frombuffer(ends, np.int64, len(blobs) + 1, blobs.offset * 8) // 4 if len(blobs) else np.zeros(1, np.int64)
    f = np.frombuffer(body, np.int32) if len(blobs) and body.size else np.empty(0, np.int32)
    return fit(f, cuts, label, bits)


def score(docs: DataFrame, model: Quality, folds: int = 5) -> DataFrame:
    """doc_id, held_out and score of every row. The model has 2**bits numbers, whatever the corpus, and goes with the tasks."""
    weights = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        m = weights.value
        for batch in batches:
            data, offsets = column(batch.column(1))
            for i, j in chunks(offsets):
                f, cuts = features(data, offsets, i, j, m.bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(m.scores(f, cuts))], schema=schema)

    return X.corpus(docs).mapInArrow(run, "doc_id long, score double").select(X.DOC, held_out(folds), "score")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from the threshold on) of every row.

    A null or empty text has no n-grams and gets the score of the intercept. Rows that repeat a doc_id are each scored;
    a doc_id labelled more than once counts as its best label; labels other than 0 and 1 and null doc_ids aren't learnt from. With labels
    of one class alone, or none, every score is that class's smoothed share. Other columns are never looked at.
    """
    return score(docs, learn(docs, labels, **how)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Quality, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold. Nothing is shuffled."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        m = weights.value
        data, offsets = column(pa.array(text, pa.string(), from_pandas=True))
        return pd.Series(np.concatenate([m.scores(*features(data, offsets, i, j, m.bits)) for i, j in chunks(offsets)]) if len(text) else np.empty(0))

    return docs.where(scored(F.col(X.TEXT).cast("string")) >= threshold)
