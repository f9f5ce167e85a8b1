"""Weighted averages of word vectors for sentences.

Two plans give the same numbers. Vectors of a checked size go to every task, where a batch of sentences is looked up, gathered
and summed without a shuffle. Larger ones are joined: tokens are counted within each sentence first, so a
frequent word costs a row a sentence; the most frequent words are few and go to every task, so no word of the
shuffled rest is hot.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.mapped import mapped, packed, trim
from ..functions.subword import MAX_NGRAMS, buckets, hashed_ngrams
from ..sources.vectors import BROADCAST_BYTES, WordVectors

STEP = 1 << 15  # tokens whose vectors are gathered at once
LOOKED_UP = 1 << 20  # words that are looked up at once
MADE_BYTES = 32 << 20  # of vectors that are made at once for words outside a vocabulary
HASHED = 1 << 13  # words whose n-grams are hashed at once
HOT_WORDS = 4096  # the most frequent words, whose vectors are always sent along


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer: one file is one task otherwise."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


class _Table:
    """Words, their vectors as they are stored and their weights; with sub-words also the n-grams' vectors. The arrays may be mapped from files."""

    def __init__(self, parts: dict[str, np.ndarray], grams: dict[str, np.ndarray] | None = None, shape: tuple[int, int, int, int] | None = None):
        n = len(parts["weights"])
        valid = pa.py_buffer(parts["valid"]) if "valid" in parts else None
        self.words = pa.StringArray.from_buffers(n, pa.py_buffer(parts["offsets"]), pa.py_buffer(parts["text"]), valid)
        self.vectors, self.weights = parts["vectors"], parts["weights"]
        self.size = self.vectors.shape[1]
        self.top = float(self.weights.max(initial=0.0))
        self.grams, self.shape = None if grams is None else grams["vectors"], shape  # shape: buckets, least and most characters, most n-grams
        self.step = STEP if grams is None else max(STEP, MADE_BYTES // (8 * self.size))

    def made(self, words: list[str]) -> np.ndarray:
        """Vectors of words outside the vocabulary: the largest weight times the mean of their n-grams' vectors; zero without n-grams."""
        out = np.zeros((len(words), self.size))
        for a in range(0, len(words), HASHED):
            of, bucket = hashed_ngrams(words[a : a + HASHED], *self.shape)
            size = np.bincount(of, minlength=len(words[a : a + HASHED]))
            begin = np.cumsum(size) - size
            for x in range(0, len(size), 1024):
                y = min(x + 1024, len(size))
                lo, hi = int(begin[x]), int(begin[y - 1] + size[y - 1])
                some = np.flatnonzero(size[x:y])
                if hi > lo:
                    out[a + x + some] = np.add.reduceat(self.grams[bucket[lo:hi]].astype(np.float64), begin[x + some] - lo)
            out[a : a + len(size)] *= (self.top / np.maximum(size, 1))[:, None]
        return out

    def weighted(self, place: np.ndarray) -> np.ndarray:
        return self.vectors[place].astype(np.float64) * self.weights[place][:, None]

    def of_tokens(self, place: np.ndarray, words: pa.Array | None) -> np.ndarray:
        """Weighted vectors of tokens: of those at a place of the vocabulary, and of those at -1 that are made from their n-grams."""
        lost = place < 0
        if words is None or not lost.any():
            return self.weighted(place)
        coded = words.filter(pa.array(lost)).fill_null("").dictionary_encode()
        out = np.empty((len(place), self.size))
        out[~lost] = self.weighted(place[~lost])
        out[lost] = self.made(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return out

    def sums(self, words: pa.ListArray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each list of words the sum of the weighted vectors of those that are known, and how many are; with sub-words all are. most: of so
        many of the first ones alone."""
        cuts = words.offsets.to_numpy()
        cuts = cuts - cuts[0]
        every = words.flatten()
        got, a = [(np.zeros((0, self.size)), np.zeros(0, np.int64))], 0
        while a < len(words):  # as many sentences as have LOOKED_UP words
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + LOOKED_UP, "right")) - 1)
            got.append(self.sums_of(every.slice(cuts[a], cuts[b] - cuts[a]), cuts[a : b + 1] - cuts[a], most))
            a = b
        return np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])

    def sums_of(self, every: pa.Array, cuts: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """sums() of the lists that lie between cuts of all their words."""
        place = pc.index_in(every, value_set=self.words.cast(every.type)).fill_null(-1).to_numpy()
        if self.grams is None:
            known = place >= 0
            cuts = np.concatenate([[0], np.cumsum(known)])[cuts]
            place, every = place[known], None
        if most is not None:
            keep = np.arange(len(place)) - np.repeat(cuts[:-1], np.diff(cuts)) < most
            place, every = place[keep], None if every is None else every.filter(pa.array(keep))
            cuts = np.concatenate([[0], np.cumsum(np.minimum(np.diff(cuts), most))])
        some = lambda x, y: self.of_tokens(place[x:y], None if every is None else every.slice(x, y - x))
        out = np.zeros((len(cuts) - 1, self.size))
        count = np.diff(cuts)
        a = 0
        while a < len(count):  # as many sentences as have `step` tokens; a long one in pieces
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + self.step, "right")) - 1)
            if cuts[b] - cuts[a] > 2 * self.step:
                for x in range(cuts[a], cuts[b], self.step):
                    out[a] += some(x, min(x + self.step, cuts[b])).sum(axis=0)
            elif cuts[b] > cuts[a]:
                full = np.flatnonzero(count[a:b]) + a
                out[full] = np.add.reduceat(some(cuts[a], cuts[b]), cuts[full] - cuts[a])
            a = b
        return out, count


class _Tables:
    """Broadcasts that a _Table is read from: mapped in a worker, so that an executor's workers share the pages."""

    def __init__(self, wv: WordVectors, most_ngrams: int = MAX_NGRAMS):
        sc = wv.vocab.sparkSession.sparkContext
        self.words = _once(wv.vocab, sc, ("words", wv.size), lambda: _words_of(wv))
        self.grams = self.shape = None
        if wv.subword:
            self.grams = _once(wv.ngrams, sc, ("grams", wv.size, wv.bucket), lambda: _grams_of(wv))
            self.shape = (wv.bucket, wv.min_n, wv.max_n, most_ngrams)

    def table(self) -> _Table:
        return _Table(mapped(self.words), None if self.grams is None else mapped(self.grams), self.shape)


_sent: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def _once(table: DataFrame, sc, key: tuple, parts):
    """The broadcast of what parts() makes from a table; one that was sent is used again while the table is."""
    have = _sent.setdefault(table, {})
    if key not in have:
        have[key] = sc.broadcast(packed(parts()))
    return have[key]


def _words_of(wv: WordVectors) -> dict[str, np.ndarray]:
    got = wv.vocab.select(F.col("word").cast("string"), "vector", F.col("weight").cast("double")).toArrow()
    words = pa.concat_arrays([c.cast(pa.string()) for c in got.column("word").chunks] or [pa.array([], pa.string())])
    if words.offset:
        words = words.take(pa.array(np.arange(len(words))))
    valid, offsets, text = words.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
    out = {"vectors": _matrix(got.column("vector"), wv.size), "weights": got.column("weight").to_numpy(), "offsets": offsets, "text": np.frombuffer(text, np.uint8) if text is not None else np.zeros(0, np.uint8)}
    return out | ({"valid": np.frombuffer(valid, np.uint8)} if words.null_count else {})


def _grams_of(wv: WordVectors) -> dict[str, np.ndarray]:
    got = wv.ngrams.select(F.col("bucket_id").cast("long"), "vector").toArrow()
    rows = _matrix(got.column(1), wv.size)
    out = np.zeros((wv.bucket, wv.size), rows.dtype)
    out[got.column(0).to_numpy()] = rows
    return {"vectors": out}


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows in single precision if they are stored so."""
    kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
    out, at = np.empty((len(column), size), kind), 0
    for chunk in column.chunks:
        out[at : at + len(chunk)] = chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        at += len(chunk)
    return out


def _lists(column: pa.Array) -> pa.ListArray:
    if column.null_count:
        column = pc.fill_null(column, pa.scalar([], column.type))
    return column


def _array(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def sentence_sums(corpus: DataFrame, wv: WordVectors, keep: list[str], most_words: int | None = None, most_ngrams: int = MAX_NGRAMS) -> DataFrame:
    """The columns `keep`, `sums` (sum of the weighted vectors of known words) and `known` (how many), a row for each row. With sub-words all words
    are known.

    most_words: words after that many known ones of a sentence are left out.
    """
    if wv.bytes <= BROADCAST_BYTES:
        return _sums_here(corpus, wv, keep, most_words, most_ngrams)
    if corpus.isStreaming:
        raise ValueError(f"a stream's words can't be joined to vectors of more than {BROADCAST_BYTES} bytes")
    if wv.subword:
        if most_words is not None:
            corpus = corpus.withColumn("words", F.slice("words", 1, most_words))
        out = sums_joined(corpus.withColumn("_n", F.size("words").cast("long")), with_unknown(corpus, wv, most_ngrams), [*keep, "_n"], None)
        return out.withColumn("known", F.greatest("_n", F.lit(0))).drop("_n")
    return sums_joined(corpus, wv, keep, most_words)


def _sums_here(corpus: DataFrame, wv: WordVectors, keep: list[str], most_words: int | None, most_ngrams: int) -> DataFrame:
    shared = _Tables(wv, most_ngrams)
    source = corpus.select(*keep, "words")
    out = source.select(*keep, F.lit(None).cast("array<double>").alias("sums"), F.lit(None).cast("long").alias("known")).schema

    def run(batches):
        table = None
        for batch in batches:
            table = table or shared.table()
            sums, known = table.sums(_lists(batch.column(len(keep))), most_words)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, _array(sums), pa.array(known, pa.int64())], names=[*keep, "sums", "known"])
            del batch, columns, sums, known  # before the next batch is read
            trim()

    return spread(source).mapInArrow(run, out)


def sums_joined(corpus: DataFrame, wv: WordVectors, keep: list[str], most_words: int | None) -> DataFrame:
    # a sentence's key follows from what it says, so a recomputed task gives the same; sentences that repeat are joined once and met twice
    rows = corpus.select(*keep, "words").withColumn("_s", F.struct(F.xxhash64(*keep, "words").alias("a"), F.xxhash64(F.lit(1), *keep, "words").alias("b")))
    vocab = wv.vocab.select("word", "vector", F.col("weight").cast("double").alias("weight"))
    tokens = rows.select("_s", "words").dropDuplicates(["_s"]).select("_s", F.posexplode("words").alias("_p", "word"))
    if most_words is not None:
        known = tokens.join(vocab.select("word"), "word")
        tokens = known.withColumn("_n", F.row_number().over(W.partitionBy("_s").orderBy("_p"))).where(F.col("_n") <= most_words)
    counted = tokens.groupBy("_s", "word").agg(F.count(F.lit(1)).alias("tf"))
    if wv.bytes <= BROADCAST_BYTES:
        met = counted.join(F.broadcast(vocab), "word")
    else:
        rank = F.col("index") if "index" in wv.vocab.columns else F.lit(None).cast("int")
        ranked = wv.vocab.select("word", "vector", F.col("weight").cast("double").alias("weight"), F.coalesce(rank < HOT_WORDS, F.lit(False)).alias("_hot"))
        hot = F.broadcast(ranked.where("_hot").drop("_hot"))
        cold = counted.join(hot.select("word"), "word", "left_anti").join(ranked.where("not _hot").drop("_hot"), "word")
        met = counted.join(hot, "word").unionByName(cold)
    part = met.select("_s", "tf", F.posexplode(F.transform("vector", lambda x: x.cast("double") * F.col("weight") * F.col("tf"))).alias("_d", "x"))
    dims = part.groupBy("_s", "_d").agg(F.sum("x").alias("x"), F.sum("tf").alias("known"))
    sums = dims.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("_d", "x"))).alias("l"), F.max("known").alias("known"))  # a row has as many entries as a vector
    sums = sums.select("_s", F.transform("l", lambda e: e["x"]).alias("sums"), "known")
    zero = F.lit([0.0] * wv.size)
    return rows.join(sums, "_s", "left").select(*keep, F.coalesce("sums", zero).alias("sums"), F.coalesce("known", F.lit(0)).cast("long").alias("known"))


def with_unknown(corpus: DataFrame, wv: WordVectors, most_ngrams: int = MAX_NGRAMS) -> WordVectors:
    """Vectors of all words of a corpus: those of a sub-word model's vocabulary, and for each other word the largest weight times the
    mean of its n-grams' vectors. A word without n-grams in range has a zero vector."""
    top = float(wv.vocab.agg(F.max("weight").cast("double")).first()[0])
    lost = corpus.select(F.explode("words").alias("word")).distinct().join(wv.vocab.select("word"), "word", "left_anti")
    ids = buckets(F.col("word"), wv.bucket, wv.min_n, wv.max_n, most_ngrams)
    grams = lost.select("word", F.size(ids).alias("g"), F.explode(ids).alias("bucket_id"))
    table = wv.ngrams.select(F.col("bucket_id").cast("long").alias("bucket_id"), F.col("vector").cast("array<double>").alias("vector"))
    made = grams.join(table, "bucket_id").groupBy("word").agg(_sum_of("vector").alias("vector"), F.first("g").alias("g"))
    made = made.select("word", F.transform("vector", lambda x: x / F.col("g")).alias("vector"), F.lit(top).alias("weight"))
    vocab = wv.vocab.select("word", F.col("vector").cast("array<double>").alias("vector"), F.col("weight").cast("double").alias("weight"), "index")
    return WordVectors(vocab.unionByName(made, allowMissingColumns=True), wv.size, wv.words + wv.bucket)  # of more bytes than are broadcast, as before


def _sum_of(column: str) -> Column:
    """Sum of arrays, place by place: a JVM aggregate with partial sums."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def mean(sums: Column | str = "sums", count: Column | str = "known") -> Column:
    """sums / count, zeros where nothing counts."""
    s, n = (F.col(c) if isinstance(c, str) else c for c in (sums, count))
    return F.transform(s, lambda x: F.when(n > 0, F.try_divide(x, n)).otherwise(F.lit(0.0)))


def averages(corpus: DataFrame, wv: WordVectors, initial: float = 0.0, dense: bool = False, most_words: int | None = None, most_ngrams: int = MAX_NGRAMS) -> DataFrame:
    """(idx, vector, known): the sum over an index's sentences of their averages, plus `initial` in every place.

    Without sub-words, words that have no vector count neither above nor below; with them, every word counts. An empty sentence, or one without
    known words, adds nothing. dense: indices from 0 to the largest all have a row.
    """
    each = sentence_sums(corpus, wv, ["idx"], most_words, most_ngrams).select("idx", mean().alias("vector"), "known")
    out = each.groupBy("idx").agg(_sum_of("vector").alias("vector"), F.sum("known").cast("long").alias("known"))
    if initial:
        out = out.select("idx", F.transform("vector", lambda x: x + F.lit(float(initial))).alias("vector"), "known")
    if dense:
        last = corpus.agg(F.max("idx")).first()[0]
        every = corpus.sparkSession.range(0 if last is None else last + 1).select(F.col("id").alias("idx"))
        out = every.join(out, "idx", "left").select("idx", F.coalesce("vector", F.lit([float(initial)] * wv.size)).alias("vector"), F.coalesce("known", F.lit(0)).cast("long").alias("known"))
    return out


def effective_counts(corpus: DataFrame, wv: WordVectors) -> tuple[int, int]:
    """(sentences, words) that count: sentences with a word; of words those with a vector, or all with sub-words."""
    if wv.subword:
        row = corpus.agg(F.sum((F.size("words") > 0).cast("int")), F.sum(F.size("words"))).first()
    else:
        row = sentence_sums(corpus, wv, ["words"]).agg(F.sum((F.size("words") > 0).cast("int")), F.sum("known")).first()
    return int(row[0] or 0), int(row[1] or 0)
