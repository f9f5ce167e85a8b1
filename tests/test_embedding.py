import numpy as np
import pytest
from pyspark.sql import functions as F

from sentloom.functions.arrays import EPS
from sentloom.operators import averaging, linalg, validation, vocabulary
from sentloom.operators.estimators import AverageEmbedding, EmbeddingModel, SIFEmbedding, USIFEmbedding
from sentloom.sources.vectors import WordVectors, word_vectors

SENTENCES = ["We agree", "Then Rosa sold plums", "run 12345", "push 12345678910111213", "", "the the of the"]
WORDS = ["the", "of", "We", "agree", "Then", "Rosa", "sold", "plums", "run"]


@pytest.fixture(scope="module")
def wv(spark):
    rows = [(w, i, 50 - 3 * i, [float(i)] * 5) for i, w in enumerate(WORDS)]
    return word_vectors(spark.createDataFrame(rows, "word string, index int, count long, vector array<float>"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, s.split()) for i, s in enumerate(SENTENCES)], "idx long, words array<string>")


def uniform(wv):
    return wv.with_vocab(vocabulary.uniform_weights(wv.vocab))


def by_idx(df):
    return {r["idx"]: np.array(r["vector"]) for r in df.collect()}


def test_scan(spark, docs):
    got = validation.scan(docs)
    assert got == validation.Scan(6, 14, 2, 1, 6)
    assert validation.scan(docs.withColumn("idx", F.lit(0))).max_index == 1
    with pytest.raises(RuntimeError):
        validation.scan(docs.withColumn("idx", F.col("idx") + 1))
    with pytest.raises(ValueError):
        validation.scan(docs.withColumn("idx", F.col("idx") - 1))
    with pytest.raises(TypeError):
        validation.scan(docs.withColumn("idx", F.col("idx").cast("string")))
    with pytest.raises(TypeError):
        validation.scan(docs.withColumn("words", F.array_join("words", " ")))
    with pytest.raises(TypeError):
        validation.scan([["a"]])
    with pytest.raises(ValueError):
        validation.scan(docs.limit(0))


def test_memory():
    assert validation.estimate_memory(int(1e8), 571, 5, 2_000_000)["Total"] == 2040025124


def test_average(spark, docs, wv):
    got = by_idx(averaging.averages(docs, uniform(wv)))
    assert np.allclose(got[0], 2.5) and np.allclose(got[1], np.mean([4, 5, 6, 7])) and np.allclose(got[2], 8)
    assert np.allclose(got[3], 0) and np.allclose(got[4], 0) and np.allclose(got[5], 0.25)
    assert averaging.effective_counts(docs.where("idx < 4"), uniform(wv)) == (4, 7)


def test_many_to_one(docs, wv):
    got = by_idx(averaging.averages(docs.withColumn("idx", F.lit(0)), uniform(wv)))
    assert np.allclose(got[0], 2.5 + 5.5 + 8 + 0.25)


def test_join_plan_is_the_same(spark, docs, wv, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), [WORDS[k] if k < 9 else "?" for k in rng.integers(0, 12, rng.integers(0, 30))]) for i in rng.integers(0, 40, 100)]
    many = spark.createDataFrame(rows + rows[:5], "idx long, words array<string>")
    weighted = wv.with_vocab(vocabulary.sif_weights(wv.vocab, 0.1))
    here = by_idx(averaging.averages(many, weighted))
    monkeypatch.setattr(averaging, "BROADCAST_BYTES", 0)
    there = by_idx(averaging.averages(many, weighted))
    weights = {r["word"]: r["weight"] for r in weighted.vocab.collect()}
    brute: dict = {}
    for i, ws in rows + rows[:5]:
        known = [WORDS.index(w) * weights[w] for w in ws if w in weights]
        brute[i] = brute.get(i, 0) + (np.mean(known) if known else 0)
    assert here.keys() == there.keys() == brute.keys()
    for i in brute:
        assert np.allclose(here[i], brute[i], atol=1e-9) and np.allclose(there[i], brute[i], atol=1e-9)


def test_truncation_and_start(docs, wv):
    got = by_idx(averaging.averages(docs, uniform(wv), most_words=2))
    assert np.allclose(got[1], 4.5) and np.allclose(got[5], 0)
    got = by_idx(averaging.averages(docs.where("idx in (0, 3)"), uniform(wv), initial=EPS, dense=True))
    assert set(got) == {0, 1, 2, 3} and np.allclose(got[1], EPS, atol=0) and np.allclose(got[0], 2.5 + EPS, atol=1e-12)


def test_subword(spark, docs, wv):
    ones = wv.vocab.withColumn("vector", F.lit([1.0] * 5)).withColumn("weight", F.lit(1.0))
    grams = spark.range(1000).select(F.col("id").cast("int").alias("bucket_id"), F.lit([2.0] * 5).alias("vector"))
    ft = WordVectors(ones, 5, len(WORDS), grams, 3, 6, 1000)
    got = by_idx(averaging.averages(docs, ft))
    assert np.allclose(got[0], 1) and np.allclose(got[2], 1.5) and np.allclose(got[3], 2) and np.allclose(got[4], 0)
    assert averaging.effective_counts(docs.where("idx < 4"), ft) == (4, 10)


COUNTS = [50, 30, 10, 5, 3, 2]


def weights(df):
    return [r["weight"] for r in df.orderBy(F.desc("count")).collect()]


def test_weights(spark):
    vocab = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate(COUNTS)], "word string, count long")
    assert np.allclose(weights(vocabulary.sif_weights(vocab)), [0.00199601, 0.00332226, 0.00990099, 0.01960784, 0.03225807, 0.04761905], atol=1e-8)
    assert np.allclose(weights(vocabulary.usif_weights(vocab, 3)), [1.2499999, 1.4705881, 1.7857143, 1.8867924, 1.9305019, 1.953125], atol=1e-6)
    assert np.allclose(weights(vocabulary.usif_weights(vocab, 11)), 2, atol=1e-5)
    bad = vocab.withColumn("count", F.lit(-1).cast("long"))
    for f in (lambda: vocabulary.sif_weights(bad), lambda: vocabulary.usif_weights(bad, 11), lambda: vocabulary.sif_weights(vocab, 0), lambda: vocabulary.usif_weights(vocab, 0)):
        with pytest.raises(ValueError):
            f()


def test_induced(spark):
    vocab = spark.createDataFrame([("the", 1), ("79", 1)], "word string, count long")
    freq = spark.createDataFrame([("the", 0.05)], "word string, freq double")
    assert {r["word"]: r["count"] for r in vocabulary.induced_counts(vocab, freq).collect()} == {"the": int(0.05 * (2**31 - 1)), "79": 21}


def test_vocabulary(spark, docs):
    got = vocabulary.build_vocabulary(docs).orderBy("index").collect()
    assert (got[0]["word"], got[0]["count"]) == ("the", 3) and [r["word"] for r in got[1:4]] == ["12345", "12345678910111213", "Rosa"]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "idx long, vector array<double>")


def matrix(df):
    return np.array([r["vector"] for r in df.orderBy("idx").collect()])


def test_components(spark):
    ones = frame(spark, np.ones((50, 10)))
    c = linalg.principal_components(ones, 1)
    assert np.allclose(matrix(linalg.remove_components(ones, c)), 0, atol=1e-9)
    half = linalg.Components(c.sigma, c.rows, np.array([0.5]))
    assert np.allclose(matrix(linalg.remove_components(ones, half)), 0.75)
    assert np.allclose(matrix(linalg.remove_components(ones, linalg.principal_components(ones, 0))), 1)
    x = np.random.default_rng(1).random((80, 10))
    c = linalg.principal_components(frame(spark, x), 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(c.sigma, s[:3]) and np.allclose(np.abs((c.rows * vt[:3]).sum(axis=1)), 1)
    once = linalg.remove_components(frame(spark, x), c)
    assert np.allclose(matrix(once), matrix(linalg.remove_components(once, c)), atol=1e-9)
    assert np.allclose(np.linalg.norm(matrix(linalg.normalised(frame(spark, x))), axis=1), 1)
    assert np.isnan(matrix(linalg.normalised(frame(spark, np.zeros((1, 3)))))).all()


@pytest.mark.parametrize("kind,more", [(AverageEmbedding, {}), (SIFEmbedding, {"components": 1}), (SIFEmbedding, {"components": 0}), (USIFEmbedding, {"length": 11, "components": 2})])
def test_estimators(spark, docs, tmp_path, kind, more):
    rng = np.random.default_rng(0)
    rows = [(w, i, 50 - 3 * i, [float(x) for x in rng.random(5)]) for i, w in enumerate(WORDS)]
    wv = word_vectors(spark.createDataFrame(rows, "word string, index int, count long, vector array<float>"))
    model = kind(wv, **more).fit(docs)
    assert model.summary == (5, 11) and len(model.sv) == 6
    raw = matrix(averaging.averages(docs, model.wv, EPS, dense=True).select("idx", "vector"))
    exp = raw
    if more.get("components"):
        _, s, vt = np.linalg.svd(raw, full_matrices=False)
        k = more["components"]
        w = s[:k] ** 2 / (s[:k] ** 2).sum() if kind is USIFEmbedding else np.ones(k)
        exp = raw - raw @ (vt[:k].T * w**2) @ vt[:k]
    assert np.allclose(matrix(model.vectors), exp, atol=1e-8)
    inferred = matrix(model.transform(docs))
    assert np.allclose(inferred[:3], matrix(model.vectors)[:3], atol=1e-6)
    model.save(str(tmp_path / "m"))
    again = EmbeddingModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(matrix(again.vectors), matrix(model.vectors)) and np.allclose(matrix(again.transform(docs)), inferred)
    assert len(model.append(docs).sv) == 12 and "vector_size=5" in repr(model) and model.memory()["Total"] > 0


def test_estimator_errors(docs, wv):
    with pytest.raises(ValueError):
        SIFEmbedding(wv, components=-1).fit(docs)
    with pytest.raises(ValueError):
        USIFEmbedding(wv, length=-1).fit(docs)
    with pytest.raises(ValueError):
        AverageEmbedding(wv).fit(docs.withColumn("words", F.array(F.lit("?"))))


def test_permutation_and_duplication(docs, wv):
    weighted = wv.with_vocab(vocabulary.sif_weights(wv.vocab))
    a = by_idx(averaging.averages(docs, weighted))
    b = by_idx(averaging.averages(docs.withColumn("words", F.reverse("words")), weighted))
    c = by_idx(averaging.averages(docs.withColumn("words", F.concat("words", "words")), weighted))
    for i in a:
        assert np.allclose(a[i], b[i]) and np.allclose(a[i], c[i])
