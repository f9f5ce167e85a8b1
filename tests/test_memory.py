"""What a worker holds of vectors that go to every task."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentloom.functions import mapped
from sentloom.functions.subword import hashed_ngrams
from sentloom.operators import averaging, vocabulary
from sentloom.sources.vectors import WordVectors, word_vectors


def table(spark, n: int, size: int):
    rng = np.random.default_rng(3)
    rows = pa.table({"word": [f"w{i}" for i in range(n)], "index": pa.array(range(n), pa.int32()), "count": pa.array(range(n, 0, -1), pa.int64()), "vector": list(rng.standard_normal((n, size)).astype(np.float32))})
    wv = word_vectors(spark.createDataFrame(rows))
    return wv.with_vocab(vocabulary.uniform_weights(wv.vocab)), rows


def test_vectors_are_mapped(spark):
    wv, rows = table(spark, 20_000, 64)
    shared = averaging._Tables(wv)
    assert averaging._Tables(wv).words is shared.words  # sent once
    tracemalloc.start()
    held = shared.table()
    sums, known = held.sums(pa.array([["w5", "?", "w7"], []], pa.list_(pa.string())))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 20  # the vectors are 5 MB in single precision
    vectors = rows.column("vector").to_pylist()
    assert known.tolist() == [2, 0] and np.array_equal(sums[0], np.add(vectors[5], vectors[7], dtype=float)) and not sums[1].any()


@pytest.mark.parametrize("where", ["file", "value"])
def test_packed_arrays(where, spark):
    arrays = {"a": np.arange(7, dtype=np.float32).reshape(7, 1), "none": np.zeros(0, np.uint8), "b": np.arange(200_000)}
    shared = spark.sparkContext.broadcast(mapped.packed(arrays))
    if where == "value":  # as where Spark encrypts the file

        class shared:  # noqa: N801
            value = bytes(mapped.packed(arrays))

    got = mapped.mapped(shared)
    assert got.keys() == arrays.keys()
    for name, x in arrays.items():
        assert got[name].dtype == x.dtype and np.array_equal(got[name], x) and got[name].flags.aligned


def test_words_outside_are_made_in_pieces(spark):
    """What is held at once follows from the size of a piece, not from the words of a batch."""
    wv, _ = table(spark, 10, 64)
    grams = pa.table({"bucket_id": pa.array(range(500), pa.int64()), "vector": list(np.random.default_rng(5).standard_normal((500, 64)).astype(np.float32))})
    wv = WordVectors(wv.vocab, 64, wv.words, spark.createDataFrame(grams), 3, 6, 500)
    held = averaging._Tables(wv).table()
    lists = [[f"other{i * 997 % 99_991}x{k}" for i in range(k, k + n)] for k, n in enumerate([60_000, 0, 3, 140_000, 1000, 100_000, 2])]
    batch = pa.array(lists, pa.list_(pa.string()))
    tracemalloc.start()
    sums, known = held.sums(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160 << 20  # the words' own vectors are 154 MB, and what hashing all of them takes is several times that
    assert known.tolist() == [len(x) for x in lists]
    vectors = np.array(grams.column("vector").to_pylist())
    for at in (2, 4, 6):
        exp = np.zeros(64)
        for w in lists[at]:
            _, ids = hashed_ngrams([w], 500)
            exp += vectors[ids].mean(axis=0)
        assert np.allclose(sums[at], exp, atol=1e-9)
    some, few = held.sums(batch, 100)
    assert few.tolist() == [min(100, len(x)) for x in lists]
    assert np.allclose(some[2], sums[2]) and np.allclose(some[4], held.sums(pa.array([lists[4][:100]], pa.list_(pa.string())))[0][0])


def test_words_are_looked_up_in_pieces(spark):
    wv, rows = table(spark, 10, 8)
    held = averaging._Tables(wv).table()
    n = 12_000_000
    offsets = np.linspace(0, n, 1001).astype(np.int32)
    words = pa.DictionaryArray.from_arrays(pa.array(np.arange(n, dtype=np.int32) % 11), ["w0", "w1", "w2", "w3", "w4", "w5", "w6", "w7", "w8", "w9", "?"]).dictionary_decode()
    batch = pa.ListArray.from_arrays(pa.array(offsets), words)
    tracemalloc.start()
    sums, known = held.sums(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20  # eight bytes for each of the batch's words are 92 MB
    vectors = np.vstack([np.array(rows.column("vector").to_pylist(), float), np.zeros(8)])
    for i in (0, 500, 999):
        at = np.arange(offsets[i], offsets[i + 1]) % 11
        assert known[i] == (at < 10).sum() and np.allclose(sums[i], vectors[at].sum(axis=0))


def test_size_of_what_is_sent(spark):
    wv, _ = table(spark, 10, 64)
    assert wv.bytes == 10 * (4 * 64 + 64)
    assert wv.with_vocab(wv.vocab.withColumn("vector", F.col("vector").cast("array<double>"))).bytes == 10 * (8 * 64 + 64)
