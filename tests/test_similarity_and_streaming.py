import numpy as np
import pytest
from pyspark.sql import functions as F

from sentloom.operators.estimators import AverageEmbedding
from sentloom.operators.evaluation import evaluate_halves, pearson
from sentloom.operators.similarity import SentenceVectors, batch_top_k, pair_scores
from sentloom.sources.vectors import word_vectors
from sentloom.streaming.inference import embed_batches, embed_stream

X = np.random.default_rng(12345).uniform(-1, 1, (60, 5))
X[41] = 0


@pytest.fixture(scope="module")
def sv(spark):
    return SentenceVectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(X)], "idx long, vector array<double>"))


def brute(q, leave=(), k=10, lo=0, hi=60):
    with np.errstate(all="ignore"):
        s = X @ q / np.linalg.norm(X, axis=1) / np.linalg.norm(q)
    ok = [i for i in range(lo, hi) if i not in leave and np.isfinite(s[i])]
    return sorted(ok, key=lambda i: (-s[i], i))[:k]


def ids(df):
    return [r["idx"] for r in df.orderBy(F.desc("similarity"), "idx").collect()]


def test_lookup(sv):
    assert np.allclose(sv[3], X[3]) and np.allclose(sv[[5, 2]], X[[5, 2]])
    assert len(sv) == 60 and 3 in sv and 60 not in sv
    assert np.isclose(np.linalg.norm(sv.get_vector(3, use_norm=True)), 1)
    with pytest.raises(KeyError):
        sv.get_vector(60)
    with pytest.raises(KeyError):
        "a" in sv  # noqa: B015
    with pytest.raises(ValueError):
        sv.get_vector(1)[0] = 2


def test_pairs(sv):
    c = X[0] @ X[1] / np.linalg.norm(X[0]) / np.linalg.norm(X[1])
    assert np.isclose(sv.similarity(0, 1), c) and np.isclose(sv.distance(0, 1), 1 - c)


def test_most_similar(spark, sv):
    u = X / np.maximum(np.linalg.norm(X, axis=1), 1e-300)[:, None]
    assert ids(sv.most_similar(0)) == brute(X[0], [0])
    assert ids(sv.most_similar(positive=[0, 3], negative=7)) == brute(u[0] + u[3] - u[7], [0, 3, 7])
    assert ids(sv.most_similar(positive=[(0, 2.0), (X[3], 0.5)])) == brute(2 * u[0] + 0.5 * X[3], [0])
    assert ids(sv.most_similar(X[4])) == brute(X[4])
    assert len(ids(sv.most_similar(20, topn=20))) == 20
    assert ids(sv.most_similar(20, restrict_size=5)) == brute(X[20], [20], 10, 0, 5)
    assert len(ids(sv.most_similar(20, topn=20, restrict_size=(5, 25)))) == 19
    assert len(ids(sv.most_similar(1, topn=20, restrict_size=(5, 25)))) == 20
    assert len(ids(sv.most_similar(0, topn=None))) == 59
    text = spark.createDataFrame([(i, f"s{i}") for i in range(60)], "idx long, text string")
    assert {r["text"] for r in sv.most_similar(0, indexable=text).collect()} == {f"s{i}" for i in brute(X[0], [0])}
    for f in (lambda: sv.most_similar(), lambda: sv.most_similar([(0, 1, 2)])):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(RuntimeError):
        sv.most_similar(0, indexable=["a"])
    with pytest.raises(KeyError):
        sv.most_similar(99)


def test_by_word_and_sentence(spark, sv):
    wv = word_vectors(spark.createDataFrame([("a", [float(x) for x in X[0]]), ("b", [float(x) for x in X[1]])], "word string, vector array<double>"))
    assert ids(sv.similar_by_word("a", wv)) == brute(X[0])
    with pytest.raises(KeyError):
        sv.similar_by_word("zzz", wv)
    model = AverageEmbedding(wv).fit(spark.createDataFrame([(0, ["a", "b"])], "idx long, words array<string>"))
    assert ids(sv.similar_by_sentence(["a", "b"], model)) == brute(X[0] + X[1])
    with pytest.raises(RuntimeError):
        sv.similar_by_sentence(["a"], object())


def test_scale_invariance(sv):
    assert ids(sv.most_similar(X[4])) == ids(sv.most_similar(X[4] * 7))


def test_batch(spark, sv, monkeypatch):
    monkeypatch.setattr("sentloom.operators.similarity.QUERY_BLOCK", 4)
    q = sv.vectors.where("idx < 10").withColumnRenamed("idx", "qid")
    got = {}
    for r in batch_top_k(q, sv.vectors, 5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["idx"])
    assert got == {i: brute(X[i], k=5) for i in range(10)}
    assert batch_top_k(q.limit(0), sv.vectors, 5).count() == 0


def test_evaluation(spark, sv):
    scores = {r["idx"]: r["similarity"] for r in pair_scores(sv.vectors, sv.vectors, 30).collect()}
    gold = [(i, float(i % 7)) for i in range(30)]
    df = spark.createDataFrame(gold, "idx long, gold double")
    got = evaluate_halves(sv.vectors, df, 30).first()[0]
    keep = [i for i in range(30) if np.isfinite(scores[i])]
    assert np.isclose(got, 100 * np.corrcoef([scores[i] for i in keep], [gold[i][1] for i in keep])[0, 1])
    assert np.isclose(pearson(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "similarity double, gold double")).first()[0], 100)


def test_save(spark, sv, tmp_path):
    sv.save(str(tmp_path / "sv"))
    assert np.allclose(SentenceVectors.load(spark, str(tmp_path / "sv"))[3], X[3])


def test_streams(spark, tmp_path):
    wv = word_vectors(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<double>"))
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"]), (2, ["?"])], "idx long, words array<string>")
    model = AverageEmbedding(wv).fit(docs)
    docs.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    embed_stream(model, stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    embed_stream(model, stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()  # nothing twice
    assert {r["idx"]: r["vector"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: [0.5, 1.5], 1: [0.0, 3.0], 2: [0.0, 0.0]}
    seen = []
    embed_batches(model, stream(), lambda df, n: seen.extend(df.collect()), str(tmp_path / "state2")).awaitTermination()
    assert len(seen) == 3
