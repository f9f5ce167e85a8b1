"""Queries over the driver's tables, each with equivalent SQL where SQL can say it. All run over whole tables.

documents.text (or conversations.text) is the corpus; the words are ranked by count, and embeddings.vec_id = rank gives word
vectors; embeddings alone serve as sentence vectors. Vectors come out as rows (.., dim, value), rounded to 6 digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import EPS
from ..functions.subword import char_ngrams, fnv
from ..functions.text import benchmark_words, words
from ..operators import linalg, similarity, validation, vocabulary
from ..operators.averaging import averages, mean, sentence_sums, spread, sums_joined, with_unknown
from ..operators.estimators import AverageEmbedding, SIFEmbedding, USIFEmbedding
from ..operators.evaluation import pearson
from ..sources.corpus import line_at, lines, scratch, sentence_pairs
from ..sources.vectors import WordVectors, word_vectors
from . import oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents", index: str = "doc_id") -> DataFrame:
    return spread(table(spark, sf_dir, name).select(F.col(index).alias("idx"), "text")).select("idx", words("text").alias("words"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"), "label")


def model_vectors(spark: SparkSession, sf_dir: str, docs: DataFrame) -> WordVectors:
    vecs = vectors(spark, sf_dir)
    ranked = vocabulary.build_vocabulary(docs, most=vecs.count())
    # as many rows as there are vectors, and used several times
    return word_vectors(ranked.join(vecs.select(F.col("idx").alias("index"), "vector"), "index").persist())


def flat(df: DataFrame, key: str = "idx", column: str = "vector", digits: int = 6, name: str | None = None) -> DataFrame:
    out = df.select(F.col(key).alias(name or key), F.posexplode(column).alias("dim", "v"))
    return out.select(name or key, F.col("dim").cast("long").alias("dim"), (F.round(F.col("v").cast("double"), digits) + 0.0).alias("value"))


def weighted(spark, sf_dir, docs, how) -> WordVectors:
    wv = model_vectors(spark, sf_dir, docs)
    return wv.with_vocab(how(wv.vocab))


# ---- corpus and vocabulary ------------------------------------------------------------------------------------------


@query(oracle.TOKENIZE)
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document."""
    return corpus(spark, sf_dir).select(F.col("idx").alias("doc_id"), F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


@query(oracle.BENCHMARK_WORDS)
def prepared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation corpus's preparation, over benchmark items."""
    made = table(spark, sf_dir, "benchmark").select("item_id", benchmark_words("text").alias("w"))
    return made.select("item_id", F.array_join("w", " ").alias("words"))


@query(oracle.SCAN)
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the five statistics of a corpus."""
    return validation.scan_statistics(corpus(spark, sf_dir))


@query(oracle.VOCAB)
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that have a vector: as many of the most frequent as there are vectors."""
    return vocabulary.build_vocabulary(corpus(spark, sf_dir), most=vectors(spark, sf_dir).count()).select("word", "count", F.col("index").cast("long").alias("index"))


@query(oracle.LINES)
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the benchmark's items as lines of text files, numbered in the order of file and place."""
    return lines(spark, _as_lines(spark, table(spark, sf_dir, "benchmark").select("item_id", _one_line("text").alias("value"))))


@query(oracle.LINES + " ORDER BY idx DESC LIMIT 1")
def last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line by its number, which counts from the end."""
    kept = lines(spark, _as_lines(spark, table(spark, sf_dir, "benchmark").select("item_id", _one_line("text").alias("value"))))
    last = kept.agg(F.max("idx")).first()[0]
    return spark.createDataFrame([(last, line_at(kept, -1))], "idx long, text string")


@query(oracle.SENTENCE_PAIRS)
def pairs_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items, tab-separated as in a similarity benchmark's file."""
    items = table(spark, sf_dir, "benchmark").select("item_id", _one_line("text").alias("t"))
    both = items.alias("a").join(items.alias("b"), F.expr("b.item_id = a.item_id + 1"))
    value = F.concat_ws("\t", F.lit("g"), F.lit("f"), F.lit("y"), F.lit("n"), (F.col("a.item_id") % 6 / 4).cast("string"), "a.t", "b.t")
    return sentence_pairs(spark, _as_lines(spark, both.select(F.col("a.item_id").alias("item_id"), value.alias("value"))))


def _one_line(text: str):
    return F.translate(text, "\r\n\t", "   ")


def _as_lines(spark: SparkSession, rows: DataFrame) -> str:
    home = scratch(spark, "lines")
    rows.orderBy("item_id").select("value").write.text(home)  # ranges in order, a file each
    return home


# ---- averages -------------------------------------------------------------------------------------------------------


@query(oracle.averages("1.0"))
def avg_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average vector of each document with a known word."""
    docs = corpus(spark, sf_dir)
    wv = weighted(spark, sf_dir, docs, vocabulary.uniform_weights)
    return flat(averages(docs, wv).where("known > 0"), name="doc_id")


@query(oracle.MANY_TO_ONE)
def avg_many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: a conversation's turns share its index; their averages are added up."""
    turns = corpus(spark, sf_dir, "conversations", "conv_id")
    wv = weighted(spark, sf_dir, turns, vocabulary.uniform_weights)
    return flat(averages(turns, wv).where("known > 0"), name="conv_id")


@query(oracle.EFFECTIVE)
def effective_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known words of each document."""
    docs = corpus(spark, sf_dir)
    wv = weighted(spark, sf_dir, docs, vocabulary.uniform_weights)
    return sentence_sums(docs, wv, ["idx"]).select(F.col("idx").alias("doc_id"), "known")


@query(oracle.truncated(10_000))
def avg_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over the first 10,000 known words of each document."""
    docs = corpus(spark, sf_dir)
    wv = weighted(spark, sf_dir, docs, vocabulary.uniform_weights)
    return flat(averages(docs, wv, most_words=10_000).where("known > 0"), name="doc_id")


@query(oracle.truncated(50))
def avg_first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages over the first 50 known words of each document, by the plan for vectors that are too large to be broadcast."""
    docs = corpus(spark, sf_dir)
    wv = weighted(spark, sf_dir, docs, vocabulary.uniform_weights)
    sums = sums_joined(docs, wv, ["idx"], 50).where("known > 0")
    return flat(sums.select("idx", mean().alias("vector")), name="doc_id")


@query(oracle.EPS_INIT)
def avg_eps_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every index has a row, which starts from the least single-precision step."""
    docs = corpus(spark, sf_dir)
    wv = weighted(spark, sf_dir, docs, vocabulary.uniform_weights)
    return flat(averages(docs, wv, initial=EPS, dense=True), name="doc_id", digits=9)


# ---- weights --------------------------------------------------------------------------------------------------------


@query(oracle.SIF_WEIGHTS)
def sif_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    return weighted(spark, sf_dir, corpus(spark, sf_dir), vocabulary.sif_weights).vocab.select("word", F.round("weight", 9).alias("weight"))


@query(oracle.USIF_WEIGHTS)
def usif_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, sentences having 11 words."""
    return weighted(spark, sf_dir, corpus(spark, sf_dir), lambda v: vocabulary.usif_weights(v, 11)).vocab.select("word", F.round("weight", 9).alias("weight"))


@query(oracle.INDUCED)
def induced_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from English frequencies, found in those of all the documents' languages."""
    docs = corpus(spark, sf_dir)
    every = table(spark, sf_dir, "documents").select("lang", F.explode(words("text")).alias("word"))
    total = every.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    freq = every.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("k")).join(total, "lang").select("lang", "word", (F.col("k") / F.col("n")).alias("freq"))
    vocab = model_vectors(spark, sf_dir, docs).vocab
    return vocabulary.induced_counts(vocab, vocabulary.language_frequencies(freq, "en")).select("word", "count")


@query(oracle.averages(oracle.SIF))
def sif_weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 with W2."""
    docs = corpus(spark, sf_dir)
    return flat(averages(docs, weighted(spark, sf_dir, docs, vocabulary.sif_weights)).where("known > 0"), name="doc_id")


@query(oracle.averages(oracle.USIF))
def usif_weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 with W3."""
    docs = corpus(spark, sf_dir)
    return flat(averages(docs, weighted(spark, sf_dir, docs, lambda v: vocabulary.usif_weights(v, 11))).where("known > 0"), name="doc_id")


# ---- similarity -----------------------------------------------------------------------------------------------------


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, (F.round("similarity", 6) + 0.0).alias("similarity"))


@query(oracle.PAIRS)
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next."""
    v = vectors(spark, sf_dir)
    return _rounded(similarity.pair_scores(v.select("idx", "vector"), v.select("idx", "vector"), 1), "idx")


@query(oracle.DISTANCES)
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5."""
    v = vectors(spark, sf_dir).select("idx", "vector")
    return similarity.pair_scores(v, v, 1).select("idx", (F.round("distance", 6) + 0.0).alias("distance"))


def _sv(spark, sf_dir) -> similarity.SentenceVectors:
    return similarity.SentenceVectors(vectors(spark, sf_dir).select("idx", "vector"))


@query(oracle.similar({0: 1}, "idx <> 0", 10))
def most_similar_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: a top-k report for one index."""
    return _rounded(_sv(spark, sf_dir).most_similar(0), "idx")


@query(oracle.similar({0: 1, 3: 1, 7: -1}, "idx NOT IN (0, 3, 7)", 10))
def most_similar_pos_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6 with inputs on both sides."""
    return _rounded(_sv(spark, sf_dir).most_similar(positive=[0, 3], negative=7), "idx")


@query(oracle.similar({0: 2, 3: 0.5}, "idx NOT IN (0, 3)", 10))
def most_similar_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6 with weighted inputs."""
    return _rounded(_sv(spark, sf_dir).most_similar(positive=[(0, 2.0), (3, 0.5)]), "idx")


@query(oracle.similar({20: 1}, "idx <> 20 AND idx >= 5 AND idx < 25", 20))
def most_similar_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a range."""
    return _rounded(_sv(spark, sf_dir).most_similar(20, topn=20, restrict_size=(5, 25)), "idx")


@query(oracle.similar({0: 1}, "TRUE", None))
def most_similar_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: all similarities, the input's own too."""
    return _rounded(_sv(spark, sf_dir).most_similar(0, topn=None), "idx")


@query(oracle.WITH_TEXT)
def most_similar_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners' texts, fetched after the limit."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "source")
    return _rounded(_sv(spark, sf_dir).most_similar(0, indexable=docs), "idx", "source")


@query(oracle.similar({1: 1}, "TRUE", 10))
def similar_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: a raw vector, whose own row isn't left out."""
    sv = _sv(spark, sf_dir)
    return _rounded(sv.similar_by_vector(sv.get_vector(1)), "idx")


@query(oracle.BY_WORD)
def similar_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: the vector of the most frequent word."""
    wv = model_vectors(spark, sf_dir, corpus(spark, sf_dir))
    first = wv.vocab.where("index = 0").first()["word"]
    return _rounded(_sv(spark, sf_dir).similar_by_word(first, wv), "idx")


@query(oracle.BY_SENTENCE)
def similar_by_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: a sentence of the three most frequent words, embedded by a plain average."""
    docs = corpus(spark, sf_dir)
    wv = model_vectors(spark, sf_dir, docs)
    three = [r["word"] for r in wv.vocab.where("index < 3").collect()]
    model = AverageEmbedding(wv).fit(docs)
    return _rounded(_sv(spark, sf_dir).similar_by_sentence(three, model), "idx")


@query(oracle.BATCH)
def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: the ten nearest rows, among all, of every vector whose index is divisible by 50."""
    v = vectors(spark, sf_dir)
    out = similarity.batch_top_k(v.where("idx % 50 = 0").select(F.col("idx").alias("qid"), "vector"), v.select("idx", "vector"), 10)
    return out.select("qid", "idx", (F.round("similarity", 6) + 0.0).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(oracle.UNIT)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9, Q3."""
    return flat(linalg.normalised(vectors(spark, sf_dir)))


@query(oracle.UNIT + " WHERE idx = 3")
def unit_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: one row's unit vector."""
    v = _sv(spark, sf_dir).get_vector(3, use_norm=True)
    return spark.createDataFrame([(3, d, round(float(x), 6) + 0.0) for d, x in enumerate(v)], "idx long, dim long, value double")


@query(oracle.LOOKUP)
def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: several rows in the asked order."""
    got = _sv(spark, sf_dir).lookup([7, 2, 11])
    return got.select(F.col("position").cast("long").alias("position"), "idx", F.posexplode("vector").alias("d", "v")).select("position", "idx", F.col("d").cast("long").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("value"))


# ---- components -----------------------------------------------------------------------------------------------------


def _fixed(spark, sf_dir, weight):
    import numpy as np

    c = _sv(spark, sf_dir).get_vector(0).astype(float)
    return linalg.Components(np.ones(1), (c / np.linalg.norm(c))[None, :], None if weight is None else np.array([weight]))


@query(oracle.removed(1.0))
def remove_component_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: without the direction of vector 0."""
    return flat(linalg.remove_components(vectors(spark, sf_dir), _fixed(spark, sf_dir, None)))


@query(oracle.removed(0.25))
def remove_component_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: a weight of 0.5 enters squared."""
    return flat(linalg.remove_components(vectors(spark, sf_dir), _fixed(spark, sf_dir, 0.5)))


@query(oracle.GRAMIAN)
def gramian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X'X of all vectors."""
    g = linalg.gramian(vectors(spark, sf_dir))
    return spark.createDataFrame([(i, j, round(float(x), 4) + 0.0) for i, row in enumerate(g) for j, x in enumerate(row)], "i long, j long, value double")


@query(oracle.SVD)
def svd_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first singular value and right singular vector, its largest entry positive."""
    c = linalg.principal_components(vectors(spark, sf_dir), 1)
    return spark.createDataFrame([(j, round(float(c.sigma[0]), 5), round(float(x), 5) + 0.0) for j, x in enumerate(c.rows[0])], "dim long, sigma double, value double")


@query(oracle.SVD_FIVE)
def svd_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five singular values and vectors, each vector's largest entry positive."""
    c = linalg.principal_components(vectors(spark, sf_dir), 5)
    return spark.createDataFrame([(k, j, round(float(s), 4), round(float(x), 4) + 0.0) for k, (s, row) in enumerate(zip(c.sigma, c.rows)) for j, x in enumerate(row)], "component long, dim long, sigma double, value double")


# ---- estimators -----------------------------------------------------------------------------------------------------


@query(oracle.SIF_EMBEDDING)
def sif_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIF vectors of all documents, without the first component."""
    docs = corpus(spark, sf_dir)
    return flat(SIFEmbedding(model_vectors(spark, sf_dir, docs)).fit(docs).vectors, digits=5, name="doc_id")


@query(oracle.USIF_EMBEDDING)
def usif_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uSIF vectors of all documents, five components being reduced."""
    docs = corpus(spark, sf_dir)
    return flat(USIFEmbedding(model_vectors(spark, sf_dir, docs), length=11).fit(docs).vectors, digits=5, name="doc_id")


@query(oracle.SIF_INFER)
def sif_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items embedded by a model of the documents."""
    docs = corpus(spark, sf_dir)
    model = SIFEmbedding(model_vectors(spark, sf_dir, docs)).fit(docs)
    return flat(model.transform(corpus(spark, sf_dir, "benchmark", "item_id")), digits=5, name="item_id")


@query(oracle.APPENDED)
def appended_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: plain averages of all documents, to which the benchmark's items are added with indices that go on."""
    docs = corpus(spark, sf_dir)
    model = AverageEmbedding(model_vectors(spark, sf_dir, docs)).fit(docs)
    return flat(model.append(corpus(spark, sf_dir, "benchmark", "item_id")).vectors)


@query(oracle.averages("1.0"))
def streaming_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, each micro-batch embedded and appended to Parquet."""
    from ..streaming.inference import embed_stream

    docs = corpus(spark, sf_dir)
    model = AverageEmbedding(model_vectors(spark, sf_dir, docs)).fit(docs)
    home = scratch(spark, "stream")
    source = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    stream = source.select(F.col("doc_id").alias("idx"), words("text").alias("words"))
    embed_stream(model, stream, f"{home}/out", f"{home}/state").awaitTermination()
    got = spark.read.parquet(f"{home}/out")
    known = sentence_sums(docs, model.wv, ["idx"]).where("known > 0").select("idx")
    return flat(got.join(known, "idx", "left_semi"), name="doc_id")


# ---- sub-words ------------------------------------------------------------------------------------------------------


@query(oracle.NGRAMS)
def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of every distinct word, as how many words each is in."""
    every = corpus(spark, sf_dir).select(F.explode("words").alias("word")).distinct()
    return every.select(F.explode(F.array_distinct(char_ngrams(F.col("word")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_words"))


@query(oracle.HASHES)
def ngram_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every distinct n-gram of the documents' words."""
    every = corpus(spark, sf_dir).select(F.explode("words").alias("word")).distinct()
    return every.select(F.explode(char_ngrams(F.col("word"))).alias("gram")).distinct().select("gram", fnv(F.col("gram")).alias("hash"))


def _subword_vectors(spark: SparkSession, sf_dir: str) -> WordVectors:
    wv = weighted(spark, sf_dir, corpus(spark, sf_dir), vocabulary.uniform_weights)
    buckets = vectors(spark, sf_dir).select(F.col("idx").alias("bucket_id"), "vector")
    return WordVectors(wv.vocab, wv.size, wv.words, buckets, 3, 6, wv.words)


@query(oracle.subword("documents", "doc_id"))
def subword_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with n-gram vectors for words outside the vocabulary."""
    return flat(averages(corpus(spark, sf_dir), _subword_vectors(spark, sf_dir)), name="doc_id")


@query(oracle.subword("benchmark", "item_id"))
def subword_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items by the plan for vectors that are too large to be broadcast, n-grams being joined to theirs."""
    items, wv = corpus(spark, sf_dir, "benchmark", "item_id"), _subword_vectors(spark, sf_dir)
    sums = sums_joined(items.withColumn("n", F.size("words")), with_unknown(items, wv), ["idx", "n"], None)
    return flat(sums.select("idx", mean("sums", "n").alias("vector")), name="item_id")


# ---- evaluation -----------------------------------------------------------------------------------------------------


@query(oracle.PEARSON)
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbours against whether their labels are equal."""
    v = vectors(spark, sf_dir)
    gold = v.alias("a").join(v.alias("b"), F.expr("b.idx = a.idx + 1")).select("a.idx", F.expr("cast(a.label = b.label as int)").alias("gold"))
    s = similarity.pair_scores(v.select("idx", "vector"), v.select("idx", "vector"), 1)
    return pearson(s.join(gold, "idx")).select(F.round("pearson", 5).alias("pearson"))

