"""Word vectors as tables: vocab (word, index, count, vector) and, with sub-words, ngrams (bucket_id, vector)."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table of vectors up to which it goes to every task; above, tokens are joined to it by shuffle.
BROADCAST_BYTES = 256 << 20


@dataclass(frozen=True)
class WordVectors:
    """vocab: word, index, count, vector and maybe weight. ngrams, min_n, max_n and bucket: for sub-word vectors alone."""

    vocab: DataFrame
    size: int
    words: int
    ngrams: DataFrame | None = None
    min_n: int = 3
    max_n: int = 6
    bucket: int = 0

    @property
    def subword(self) -> bool:
        return self.ngrams is not None

    @property
    def bytes(self) -> int:
        """Of the larger of the tables of words and n-grams, as tasks hold them: numbers as they are stored, and 64 bytes a word besides."""
        row = lambda df: self.size * (4 if dict(df.dtypes)["vector"] == "array<float>" else 8)
        return max(self.words * (row(self.vocab) + 64), self.bucket * row(self.ngrams) if self.subword else 0)

    def with_vocab(self, vocab: DataFrame) -> WordVectors:
        return dataclasses.replace(self, vocab=vocab)


def word_vectors(vocab: DataFrame, ngrams: DataFrame | None = None, min_n: int = 3, max_n: int = 6, bucket: int | None = None) -> WordVectors:
    """Checks tables of vectors and counts them. Missing columns, another element type, or rows of different sizes are errors.

    A missing index is the rank by descending count, then word; a missing count is 1.
    """
    kinds = dict(vocab.dtypes)
    if "word" not in kinds or kinds.get("vector") not in ("array<float>", "array<double>"):
        raise RuntimeError("vocab needs columns word and vector (array of float)")
    if "count" not in kinds:
        vocab = vocab.withColumn("count", F.lit(1).cast("long"))
    if "index" not in kinds:
        from ..operators.ordering import numbered

        vocab = numbered(vocab, "index", F.desc("count"), F.col("word"))
    vocab = vocab.withColumn("index", F.col("index").cast("int")).withColumn("count", F.col("count").cast("long"))
    got = vocab.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
    if not got["n"]:
        raise ValueError("no word vectors")
    if got["lo"] != got["hi"]:
        raise RuntimeError(f"vectors of {got['lo']} to {got['hi']} numbers")
    if ngrams is not None:
        kinds = dict(ngrams.dtypes)
        if "bucket_id" not in kinds or not kinds.get("vector", "").startswith("array<"):
            raise RuntimeError("ngrams needs columns bucket_id and vector")
        if bucket is None:
            bucket = int(ngrams.agg(F.max("bucket_id")).first()[0]) + 1
    return WordVectors(vocab, got["lo"], got["n"], ngrams, min_n, max_n, bucket or 0)


def read_vectors(spark: SparkSession, path: str, kind: str = "parquet") -> WordVectors:
    """Pre-trained vectors: kind "parquet" (as write_vectors leaves them, or a vocab table alone), "text" (word2vec's text format) or
    "fasttext" (fastText's binary format, with sub-words)."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    there = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    if not fs.getFileSystem(conf).exists(fs):
        raise ValueError(f"no vectors at {path}")
    if kind == "fasttext":
        return read_fasttext(spark, path)
    if kind == "text":
        from .corpus import lines

        part = F.split(F.rtrim("text"), " ")
        rows = lines(spark, path).where(F.size(part) > 2)  # the head has two numbers
        first = spark.read.text(path).limit(1).select(F.size(F.split(F.rtrim("value"), " "))).first()
        offset = 1 if first and first[0] == 2 else 0
        vocab = rows.select(part[0].alias("word"), (F.col("idx") - offset).cast("int").alias("index"), F.slice(part, 2, 1_000_000).cast("array<float>").alias("vector"))
        return word_vectors(vocab)
    if kind != "parquet":
        raise ValueError(kind)
    if not there(f"{path}/vocab"):
        return word_vectors(spark.read.parquet(path))
    params = spark.read.json(f"{path}/params").first().asDict()
    ngrams = spark.read.parquet(f"{path}/ngrams") if there(f"{path}/ngrams") else None
    return word_vectors(spark.read.parquet(f"{path}/vocab"), ngrams, int(params["min_n"]), int(params["max_n"]), int(params["bucket"]))


MAGIC, VERSION = 793712314, 12
ROWS_EACH = 1 << 14  # rows of a binary file that one task reads


def _opened(path: str):
    """A file that can be read from any place, on whatever file system its name says."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def read_fasttext(spark: SparkSession, path: str) -> WordVectors:
    """Vectors of words and n-gram buckets from a fastText model file (.bin, version 12, not quantised).

    The driver reads the head with the dictionary; tasks read ranges of the matrix from the file, which all of them must reach. A
    model without n-grams gives words alone.
    """
    import struct

    import numpy as np
    import pyarrow as pa

    with _opened(path) as f:

        def take(form: str) -> tuple:
            raw = f.read(struct.calcsize("<" + form))
            if len(raw) < struct.calcsize("<" + form):
                raise RuntimeError(f"{path} ends too early")
            return struct.unpack("<" + form, raw)

        if take("ii") != (MAGIC, VERSION):
            raise RuntimeError(f"{path} is no fastText model of version {VERSION}")
        dim, *_, bucket, min_n, max_n, _, _ = take("12id")
        size, words, _, _, pruned = take("iiiqq")
        names, counts, rest = [], [], b""
        while len(names) < size:
            end = rest.find(b"\0")
            while end < 0 or len(rest) < end + 10:
                more = f.read(1 << 20)
                if not more:
                    raise RuntimeError(f"{path} ends in its dictionary")
                rest, end = rest + more, -1
                end = rest.find(b"\0")
            count, kind = struct.unpack_from("<qb", rest, end + 1)
            if kind == 0:
                names.append(rest[:end].decode("utf-8", "replace"))
                counts.append(count)
            else:  # labels come after the words
                size -= 1
            rest = rest[end + 10 :]
        at = f.tell() - len(rest) + 8 * max(0, pruned)
        f.seek(at)
        (quantised,) = take("b")
        rows, width = take("qq")
        begin = f.tell()
    if quantised or pruned > 0 or width != dim or rows < words:
        raise RuntimeError(f"{path} is quantised or pruned, or its matrix doesn't fit its dictionary")

    def read(batches):
        with _opened(path) as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    n = min(ROWS_EACH, rows - first)
                    f.seek(begin + 4 * dim * first)
                    flat = np.frombuffer(f.read(4 * dim * n), "<f4")
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), vectors], names=["row", "vector"])

    pieces = -(-rows // ROWS_EACH)
    matrix = spark.range(0, rows, ROWS_EACH, numPartitions=max(1, pieces)).mapInArrow(read, "row long, vector array<float>")
    known = spark.createDataFrame(pa.table({"index": pa.array(range(len(names)), pa.int32()), "word": names, "count": pa.array(counts, pa.int64())}))
    vocab = known.join(matrix.where(F.col("row") < words).withColumnRenamed("row", "index"), "index")
    if not max_n or not bucket:
        return word_vectors(vocab)
    ngrams = matrix.where(F.col("row") >= words).select((F.col("row") - words).alias("bucket_id"), "vector")
    return word_vectors(vocab, ngrams, min_n, max_n, bucket)


def write_vectors(wv: WordVectors, path: str, again: bool = False) -> None:
    """Vectors as Parquet, once: what is there stays unless `again`."""
    spark = wv.vocab.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/params/_SUCCESS")
    if not again and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return
    wv.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    if wv.subword:
        wv.ngrams.write.mode("overwrite").parquet(f"{path}/ngrams")
    spark.createDataFrame([(wv.min_n, wv.max_n, wv.bucket)], "min_n int, max_n int, bucket long").write.mode("overwrite").json(f"{path}/params")


def from_ml(model, counts: DataFrame | None = None) -> WordVectors:
    """Vectors of a fitted pyspark.ml Word2VecModel. counts: (word, count)."""
    from pyspark.ml.functions import vector_to_array

    vocab = model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))
    return word_vectors(vocab if counts is None else vocab.join(counts, "word", "left").fillna({"count": 1}))


SCHEMA = T.StructType([T.StructField("word", T.StringType(), False), T.StructField("index", T.IntegerType()), T.StructField("count", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
