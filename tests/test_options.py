"""Options of the estimators, streams with sub-words, and searches whose queries repeat."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentloom.functions.subword import buckets, char_ngrams, fnv, hashed_ngrams
from sentloom.operators import averaging, linalg, validation
from sentloom.operators.estimators import AverageEmbedding, EmbeddingModel, SIFEmbedding
from sentloom.operators.similarity import batch_top_k
from sentloom.operators.vocabulary import language_frequencies
from sentloom.sources.corpus import from_list, line_at
from sentloom.sources.vectors import word_vectors
from sentloom.streaming.inference import embed_stream

SENTENCES = [["the", "cat", "unheard"], ["Überraschung", "the"], ["x"], ["cat", "cat", "the", "the"], [], ["", "日本語のテキスト"]]


@pytest.fixture(scope="module")
def subwords(spark):
    rng = np.random.default_rng(4)
    vocab = spark.createDataFrame([("the", 0, 9, rng.random(5).tolist()), ("cat", 1, 3, rng.random(5).tolist())], "word string, index int, count long, vector array<double>")
    ngrams = spark.createDataFrame([(i, rng.random(5).tolist()) for i in range(50)], "bucket_id int, vector array<double>")
    return word_vectors(vocab, ngrams, 3, 6)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(SENTENCES)), "idx long, words array<string>").repartition(2)


def rows(df):
    return {r["idx"]: np.array(r["vector"]) for r in df.collect()}


def same(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def plain_fnv(b):
    h = 2166136261
    for x in b:
        h = ((h ^ (x if x < 128 else x + 4294967040)) * 16777619) & 0xFFFFFFFF
    return h


def test_ngrams_of_a_batch_are_those_of_each_word(spark):
    words = ["", "a", "cat", "Überraschung", "日本語のテキスト", "x" * 30]
    of, ids = hashed_ngrams(words, 50, 3, 6, 40)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    grams = {r["i"]: r["g"] for r in df.select("i", char_ngrams(F.col("w")).alias("g")).collect()}
    exp = [[plain_fnv(g.encode()) % 50 for g in grams[i][:40]] for i in range(len(words))]
    assert [ids[of == i].tolist() for i in range(len(words))] == exp
    assert [r["b"] for r in df.orderBy("i").select(buckets(F.col("w"), 50).alias("b")).collect()] == exp
    got = df.select("w", fnv(F.col("w")).alias("h"), fnv(F.lit(None).cast("string")).alias("none")).collect()
    assert all(r["h"] == plain_fnv(r["w"].encode()) and r["none"] is None for r in got)


def test_subword_plans_agree(corpus, subwords, monkeypatch):
    wv = subwords.with_vocab(subwords.vocab.withColumn("weight", F.lit(0.5)))
    for most in (None, 1, 2):
        here = averaging.averages(corpus, wv, most_words=most, most_ngrams=7)
        exp = rows(here)
        monkeypatch.setattr(averaging, "BROADCAST_BYTES", 0)
        assert same(rows(averaging.averages(corpus, wv, most_words=most, most_ngrams=7)), exp)
        monkeypatch.undo()
    cat, the = (np.array(r["vector"]) / 2 for r in wv.vocab.orderBy("word").collect())
    assert np.allclose(exp[3], (cat + cat) / 2) and np.allclose(exp[1], (the + rows(here)[1] * 2 - the) / 2)


def test_streams_of_subword_models(spark, corpus, subwords, tmp_path):
    model = AverageEmbedding(subwords, max_words=2, max_ngrams=9).fit(corpus)
    exp = rows(model.transform(corpus))
    corpus.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(corpus.schema).parquet(str(tmp_path / "in"))
    embed_stream(model, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert same(rows(spark.read.parquet(str(tmp_path / "out"))), exp)
    model.save(str(tmp_path / "model"))
    kept = EmbeddingModel.load(spark, str(tmp_path / "model"))
    assert (kept.max_words, kept.max_ngrams) == (2, 9) and same(rows(kept.transform(corpus)), exp)


def test_frequencies_of_a_language(spark, corpus, subwords):
    table = spark.createDataFrame([("en", "the", 0.5), ("en", "cat", 0.25), ("de", "cat", 0.125)], "lang string, word string, freq double")
    assert {r["word"]: r["freq"] for r in language_frequencies(table, "de").collect()} == {"cat": 0.125}
    with pytest.raises(ValueError, match="de, en"):
        language_frequencies(table, "xx")
    with pytest.raises(ValueError):
        SIFEmbedding(subwords, lang_freq="en").fit(corpus)
    model = SIFEmbedding(subwords, frequencies=table, lang_freq="en", components=0).fit(corpus)
    weight = {r["word"]: r["weight"] for r in model.wv.vocab.collect()}
    assert np.isclose(weight["the"], 1e-3 / (1e-3 + 2 / 3)) and np.isclose(weight["cat"], 1e-3 / (1e-3 + 1 / 3))


def test_components_of_a_sample(spark):
    some = SIFEmbedding(word_vectors(spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<double>")), cache_size_gb=1e-6)
    assert some.sample(10) == 1.0 and np.isclose(some.sample(10_000), 1e-6 * 2**30 / 80_000)
    assert SIFEmbedding(some.wv).sample(10**12) is None


def test_a_model_gives_its_storage_back(spark, corpus, subwords):
    model = AverageEmbedding(subwords).fit(corpus)
    exp = rows(model.vectors)
    assert model.kept.is_cached
    model.unpersist()
    assert not model.kept.is_cached and same(rows(model.vectors), exp)


def test_memory_is_warned_of(spark):
    with pytest.warns(UserWarning, match="GB"):
        validation.warn_memory(1 << 60, spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        validation.warn_memory(1000, spark)


def test_queries_that_repeat_or_have_no_id(spark, monkeypatch):
    from sentloom.operators import similarity

    rng = np.random.default_rng(6)
    vectors = [(i, rng.random(3).tolist()) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, [1.0, 1.0, 1.0]), (42, [2.0, 2.0, 2.0])]
    queries = [(5, rng.random(3).tolist()), (5, rng.random(3).tolist()), (None, [1.0, 1.0, 1.0]), (9, rng.random(3).tolist()), (None, [0.0, 0.0, 0.0])]
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 2)
    monkeypatch.setattr(similarity, "QUERY_BYTES", 48)
    df = spark.createDataFrame(vectors, "idx long, vector array<double>").repartition(3)
    got = batch_top_k(spark.createDataFrame(queries, "qid long, vector array<double>"), df, 4).collect()
    exp = []
    for q, v in queries:
        score = sorted((-(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))), i) for i, x in vectors if np.any(x) and np.any(v))
        exp += [(q, i, round(-s, 9), k + 1) for k, (s, i) in enumerate(score[:4])]
    key = lambda r: (str(r[0]), r[3], r[1])
    assert sorted(((r["qid"], r["idx"], round(r["similarity"], 9), r["rank"]) for r in got), key=key) == sorted(exp, key=key)
    assert batch_top_k(spark.createDataFrame([], "qid long, vector array<double>"), df).count() == 0


def test_rows_without_a_vector_stay(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, None), (2, [0.0, 0.0])], "idx long, vector array<double>")
    unit = {r["idx"]: r["vector"] for r in linalg.normalised(df).collect()}
    assert unit[0] == [0.6, 0.8] and unit[1] is None and all(np.isnan(unit[2]))
    left = linalg.remove_components(df, linalg.Components(np.ones(1), np.array([[1.0, 0.0]]), np.array([0.5])))
    assert {r["idx"]: r["vector"] for r in left.collect()} == {0: [2.25, 4.0], 1: None, 2: [0.0, 0.0]}


def test_last_line_of_one(spark):
    one = from_list(spark, ["only "])
    assert line_at(one, -1) == "only" == line_at(one, 0)
    with pytest.raises(IndexError):
        line_at(one.where("false"), -1)


def test_fasttext_files(spark, tmp_path, monkeypatch):
    import struct

    from sentloom.sources import vectors

    monkeypatch.setattr(vectors, "ROWS_EACH", 4)
    rng, names, bucket = np.random.default_rng(2), ["the", "Überraschung", "cat"], 8
    matrix = rng.random((len(names) + bucket, 3)).astype("<f4")

    def model(version=12, quantised=0, labels=(), max_n=6):
        entries = b"".join(w.encode() + b"\0" + struct.pack("<qb", 9 - i, kind) for kind, some in ((0, names), (1, labels)) for i, w in enumerate(some))
        head = struct.pack("<ii", 793712314, version) + struct.pack("<12id", 3, 5, 5, 1, 5, 1, 2, 1, bucket, 3, max_n, 100, 1e-4)
        return head + struct.pack("<iiiqq", len(names) + len(labels), len(names), len(labels), 99, -1) + entries + struct.pack("<bqq", quantised, *matrix.shape) + matrix.tobytes() + b"rest"

    path = str(tmp_path / "m.bin")
    for labels in ((), ("__label__a",)):
        (tmp_path / "m.bin").write_bytes(model(labels=labels))
        wv = vectors.read_vectors(spark, path, "fasttext")
        assert (wv.size, wv.words, wv.bucket, wv.min_n, wv.max_n) == (3, 3, 8, 3, 6)
        assert [(r["word"], r["count"], r["vector"]) for r in wv.vocab.orderBy("index").collect()] == [(w, 9 - i, matrix[i].tolist()) for i, w in enumerate(names)]
        assert [r["vector"] for r in wv.ngrams.orderBy("bucket_id").collect()] == matrix[3:].tolist()
    (tmp_path / "m.bin").write_bytes(model(max_n=0))
    assert not vectors.read_vectors(spark, path, "fasttext").subword
    for bad in (model(version=11), model(quantised=1), model()[:80]):
        (tmp_path / "m.bin").write_bytes(bad)
        with pytest.raises(RuntimeError):
            vectors.read_vectors(spark, path, "fasttext")
