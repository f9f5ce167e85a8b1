"""Embedding of sentences as they arrive: stateless, since each record has all its words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.estimators import EmbeddingModel


def embed_stream(model: EmbeddingModel, sentences: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, use_norm: bool = False) -> StreamingQuery:
    """Writes (idx, vector) of a stream (idx, words) to Parquet at path, each record once. trigger: as of writeStream; all there is and no more by default."""
    out = model.transform(sentences, use_norm)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def embed_batches(model: EmbeddingModel, sentences: DataFrame, sink, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Calls sink(vectors, batch number) for every micro-batch; several sentences of an index within one are added up."""
    return sentences.writeStream.foreachBatch(lambda df, n: sink(model.transform(df), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
