"""Sentence embeddings as estimators: fit a corpus (idx, words), get a model with `.sv`, transform others."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import EPS
from ..functions.subword import MAX_NGRAMS
from ..sources.vectors import WordVectors, read_vectors, write_vectors
from . import validation
from .averaging import averages
from .linalg import Components, normalised, principal_components, remove_components
from .similarity import SentenceVectors
from .vocabulary import induced_counts, language_frequencies, sif_weights, uniform_weights, usif_weights


@dataclass(frozen=True)
class Embedding(ABC):
    """What the estimators share. frequencies: a table (word, freq) that replaces the counts, or (lang, word, freq), of which lang_freq names the
    language; initial: what trained rows start from; max_words: words of a sentence that count, none for all; max_ngrams: n-grams of a
    word outside the vocabulary that count; cache_size_gb: sentence vectors beyond so many GB in single precision are sampled for the components, none: never."""

    wv: WordVectors
    frequencies: DataFrame | None = None
    initial: float = EPS
    max_words: int | None = None
    lang_freq: str | None = None
    max_ngrams: int = MAX_NGRAMS
    cache_size_gb: float | None = None

    @abstractmethod
    def weighted(self, vocab: DataFrame, scan: validation.Scan) -> DataFrame:
        """vocab with a column weight."""

    @abstractmethod
    def check(self, vocab: DataFrame) -> None:
        """Raises where parameters or weights make no sense."""

    def components_of(self, vectors: DataFrame, rows: int) -> Components | None:
        return None

    def sample(self, rows: int) -> float | None:
        """The share of so many sentence vectors that the components are made from."""
        if self.cache_size_gb is None:
            return None
        return min(1.0, self.cache_size_gb * 2**30 / max(1, rows * self.wv.size * 4))

    def prepared(self, scan: validation.Scan) -> WordVectors:
        freq = self.frequencies
        if self.lang_freq is not None:
            if freq is None:
                raise ValueError("lang_freq needs a table of frequencies (lang, word, freq)")
            freq = language_frequencies(freq, self.lang_freq)
        vocab = self.wv.vocab if freq is None else induced_counts(self.wv.vocab, freq)
        vocab = self.weighted(vocab, scan)
        self.check(vocab)
        return self.wv.with_vocab(vocab)

    def fit(self, corpus: DataFrame) -> EmbeddingModel:
        """Statistics, weights, averages, components. Rows of an index that no sentence has are `initial` throughout."""
        scan = validation.scan(corpus)
        wv = self.prepared(scan)
        validation.warn_memory(validation.estimate_memory(scan.max_index, wv.words, wv.size, wv.bucket if wv.subword else None)["Total"], corpus.sparkSession)
        raw = averages(corpus, wv, self.initial, dense=True, most_words=self.max_words, most_ngrams=self.max_ngrams).persist()
        kept = raw
        sentences = scan.total_sentences - scan.empty_sentences
        words = scan.total_words if wv.subword else int(raw.agg(F.sum("known")).first()[0] or 0)
        validation.check_result(sentences, words)
        raw = raw.select("idx", "vector")
        parts = self.components_of(raw, scan.max_index)
        return EmbeddingModel(type(self).__name__, wv, parts, remove_components(raw, parts) if parts else raw, scan, (sentences, words), self.max_words, self.max_ngrams, kept)


@dataclass(frozen=True)
class AverageEmbedding(Embedding):
    """Plain average: every weight is 1."""

    def weighted(self, vocab, scan):
        return uniform_weights(vocab)

    def check(self, vocab):
        validation.check_weights(vocab, 1, 1)


@dataclass(frozen=True)
class SIFEmbedding(Embedding):
    """Smooth inverse frequency weights, and removal of the first components."""

    alpha: float = 1e-3
    components: int = 1

    def weighted(self, vocab, scan):
        return sif_weights(vocab, self.alpha)

    def check(self, vocab):
        if self.components < 0:
            raise ValueError("components must be 0 or more")
        validation.check_weights(vocab, 0, 1)

    def components_of(self, vectors, rows):
        return principal_components(vectors, self.components, sample=self.sample(rows)) if self.components else None


@dataclass(frozen=True)
class USIFEmbedding(Embedding):
    """Unsupervised SIF: weights from the sentences' length (their mean, if none is given), components weighted by their shares."""

    length: float | None = None
    components: int = 5

    def weighted(self, vocab, scan):
        return usif_weights(vocab, scan.average_length if self.length is None else self.length)

    def check(self, vocab):
        if self.components < 0:
            raise ValueError("components must be 0 or more")
        validation.check_weights(vocab, 0, None)

    def components_of(self, vectors, rows):
        if not self.components:
            return None
        parts = principal_components(vectors, self.components, sample=self.sample(rows))
        share = parts.sigma**2 / max((parts.sigma**2).sum(), np.finfo(float).tiny)
        return replace(parts, weights=share)


@dataclass(frozen=True)
class EmbeddingModel:
    kind: str
    wv: WordVectors
    components: Components | None
    vectors: DataFrame
    scan: validation.Scan
    summary: tuple[int, int]
    max_words: int | None = None
    max_ngrams: int = MAX_NGRAMS
    kept: DataFrame | None = None  # what fit() holds in the executors' storage

    def unpersist(self) -> None:
        """Frees what fit() keeps in the executors' storage; vectors that are asked for later are computed anew."""
        if self.kept is not None:
            self.kept.unpersist()

    @property
    def sv(self) -> SentenceVectors:
        return SentenceVectors(self.vectors)

    def transform(self, corpus: DataFrame, use_norm: bool = False) -> DataFrame:
        """(idx, vector) of other sentences, starting from zero. Works on streams too, where an index is a sentence of its own."""
        validation.check_schema(corpus)
        if corpus.isStreaming:
            from .averaging import mean, sentence_sums

            out = sentence_sums(corpus, self.wv, ["idx"], self.max_words, self.max_ngrams).select("idx", mean().alias("vector"))
        else:
            out = averages(corpus, self.wv, most_words=self.max_words, most_ngrams=self.max_ngrams).select("idx", "vector")
        if self.components:
            out = remove_components(out, self.components)
        return normalised(out) if use_norm else out

    def append(self, corpus: DataFrame) -> EmbeddingModel:
        """The model with more sentences, whose indices go on after the last; weights and components stay."""
        last = self.vectors.agg(F.max("idx")).first()[0]
        more = self.transform(corpus).withColumn("idx", F.col("idx") + F.lit(0 if last is None else last + 1))
        return replace(self, vectors=self.vectors.unionByName(more))

    def memory(self) -> dict[str, int]:
        return validation.estimate_memory(self.scan.max_index, self.wv.words, self.wv.size, self.wv.bucket if self.wv.subword else None)

    def __repr__(self) -> str:
        return f"{self.kind}(vector_size={self.wv.size}, sentences={self.scan.max_index}, words={self.wv.words})"

    def save(self, path: str) -> None:
        write_vectors(self.wv, f"{path}/wv", again=True)
        self.vectors.write.mode("overwrite").parquet(f"{path}/sv")
        c = self.components
        about = {"kind": self.kind, "scan": asdict(self.scan), "summary": self.summary, "max_words": self.max_words, "max_ngrams": self.max_ngrams, "components": None if c is None else {"sigma": c.sigma.tolist(), "rows": c.rows.tolist(), "weights": None if c.weights is None else c.weights.tolist()}}
        self.vectors.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> EmbeddingModel:
        about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        c = about["components"]
        parts = None if c is None else Components(np.array(c["sigma"]), np.array(c["rows"]), None if c["weights"] is None else np.array(c["weights"]))
        return EmbeddingModel(about["kind"], read_vectors(spark, f"{path}/wv"), parts, spark.read.parquet(f"{path}/sv"), validation.Scan(**about["scan"]), tuple(about["summary"]), about["max_words"], about["max_ngrams"])
