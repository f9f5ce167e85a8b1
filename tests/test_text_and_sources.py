import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentloom.functions.subword import buckets, char_ngrams, fnv
from sentloom.functions.text import benchmark_words, custom_words, words
from sentloom.sources import corpus
from sentloom.sources.vectors import from_ml, read_vectors, word_vectors, write_vectors


def test_split_is_pythons(spark):
    texts = ["The Dog is good", "", None, " a  b c d\n\te ", "\x1c x​ y \x00", "a　b\x85c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx long, text string")
    got = {r[0]: r[1] for r in rows.select("idx", words("text")).collect()}
    assert got == {i: (t or "").split() for i, t in enumerate(texts)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" ab \n \x1d z", max_size=20), min_size=20, max_size=60))
def test_split_property(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    assert [r[0] for r in rows.orderBy("idx").select(words("text")).collect()] == [t.split() for t in texts]


def test_custom_split(spark):
    rows = spark.createDataFrame([(0, "The Dog"), (1, None)], "idx long, text string")
    native = rows.orderBy("idx").select(custom_words("text", lambda c: F.split(F.lower(c), " "))).collect()
    assert native[0][0] == ["the", "dog"]
    python = rows.orderBy("idx").select(custom_words("text", lambda t: t.upper().split(" "))).collect()
    assert [r[0] for r in python] == [["THE", "DOG"], []]


def test_benchmark_words(spark):
    row = spark.createDataFrame([("A well-known \"quote\": I don't -- know.",)], "t string").select(benchmark_words("t")).first()[0]
    assert row == ["a", "well", "known", "quote", "i", "do", "not", "know"]


def test_lists(spark):
    one = corpus.from_list(spark, ["The Dog is good", "it runs"], split=True)
    assert [tuple(r) for r in one.orderBy("idx").collect()] == [(0, ["The", "Dog", "is", "good"]), (1, ["it", "runs"])]
    two = corpus.from_list(spark, ["a"], ["b", "c"])
    assert [r["text"] for r in two.orderBy("idx").collect()] == ["a", "b", "c"]
    assert corpus.from_list(spark, ["x", "y"], index=[1, 1]).select("idx").collect() == [(1,), (1,)]
    with pytest.raises(RuntimeError):
        corpus.from_list(spark, ["x"], index=[1, 2])
    with pytest.raises(TypeError):
        corpus.from_list(spark, "x")
    more = corpus.extend(two, corpus.from_list(spark, ["d"]))
    assert more.orderBy("idx").collect()[-1] == (3, "d")
    assert corpus.without(more, 1).count() == 3
    assert corpus.replaced(more, 0, "z").where("idx = 0").first()["text"] == "z"


def test_lines(spark, tmp_path):
    p = tmp_path / "a.txt"
    rows = [f"line {i}  " if i % 7 else "" for i in range(5000)]
    p.write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = corpus.lines(spark, str(p)).orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == list(enumerate(rows))
    df = corpus.lines(spark, str(p))
    assert corpus.line_at(df, 19) == "line 19" and corpus.line_at(df, -1) == "line 4999"
    with pytest.raises(IndexError):
        corpus.line_at(df, 6000)


def test_sentence_pairs(spark, tmp_path):
    (tmp_path / "sts.tsv").write_text('g\tf\ty\t1\t4.5\tA "dog\tA cat\ng\tf\ty\t2\t0.0\tx\ty\textra\n')
    got = corpus.sentence_pairs(spark, str(tmp_path / "sts.tsv")).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(0, 4.5, 'A "dog', "A cat"), (1, 0.0, "x", "y")]


def test_ngrams(spark):
    def plain(w, lo=3, hi=6):
        e = f"<{w}>"
        return [e[i : i + n] for i in range(len(e)) for n in range(lo, hi + 1) if i + n <= len(e)]

    def plain_hash(g):
        h = 2166136261
        for b in g.encode():
            h = ((h ^ (b + 0xFFFFFF00 if b >= 128 else b)) * 16777619) & 0xFFFFFFFF
        return h

    ws = ["12345", "12345678910111213", "é", "a", "", "naïve-ß"]
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    for w, g, b in df.select("w", char_ngrams(F.col("w")), buckets(F.col("w"), 1000)).collect():
        assert g == plain(w) and b == [plain_hash(x) % 1000 for x in plain(w)[:40]]
    assert len(plain("12345")) == 14 and len(plain("12345678910111213")) == 62
    assert all(r[1] == plain_hash(r[0]) for r in df.select("w", fnv(F.col("w"))).collect())


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([("b", 5, [1.0, 2.0]), ("a", 5, [0.0, 1.0]), ("c", 9, [3.0, 3.0])], "word string, count long, vector array<float>")
    wv = word_vectors(df)
    assert [r["word"] for r in wv.vocab.orderBy("index").collect()] == ["c", "a", "b"] and (wv.size, wv.words) == (2, 3)
    write_vectors(wv, str(tmp_path / "v"))
    assert read_vectors(spark, str(tmp_path / "v")).vocab.count() == 3
    write_vectors(wv.with_vocab(wv.vocab.limit(1)), str(tmp_path / "v"))  # what is there stays
    assert read_vectors(spark, str(tmp_path / "v")).words == 3
    ft = word_vectors(df, spark.createDataFrame([(0, [1.0, 1.0]), (4, [2.0, 2.0])], "bucket_id int, vector array<float>"))
    write_vectors(ft, str(tmp_path / "ft"))
    again = read_vectors(spark, str(tmp_path / "ft"))
    assert again.subword and again.bucket == 5
    (tmp_path / "w.txt").write_text("2 3\nthe 0.5 1 2\nof 3 4 5\n")
    text = read_vectors(spark, str(tmp_path / "w.txt"), "text")
    assert [(r["word"], r["index"], list(r["vector"])) for r in text.vocab.orderBy("index").collect()] == [("the", 0, [0.5, 1, 2]), ("of", 1, [3, 4, 5])]
    with pytest.raises(ValueError):
        read_vectors(spark, str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        word_vectors(df.drop("vector"))
    with pytest.raises(RuntimeError):
        word_vectors(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "word string, vector array<float>"))


def test_ml_vectors(spark):
    from pyspark.ml.feature import Word2Vec

    docs = spark.createDataFrame([(["a", "b", "c"] * 5,)] * 4, "w array<string>")
    model = Word2Vec(vectorSize=4, minCount=1, inputCol="w", outputCol="v", seed=1).fit(docs)
    assert from_ml(model).size == 4
