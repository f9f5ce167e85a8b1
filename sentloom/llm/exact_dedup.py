"""Op 6. Exact copies by Golomb-coded fingerprint exchange.

Each bucket of documents sends the sorted distinct fingerprints of its texts to their owners as Golomb codes with a
power-of-two parameter; owners answer with a bitmap of those that occur elsewhere. Only documents with a marked
fingerprint, or with one that their own bucket has twice, are suspects, and only their texts are shuffled and compared:
a Bloom filter of bounded size keeps the others where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .kernel import rice_decode, rice_encode

KEYS_EACH = 1 << 18  # fingerprints of a bucket


def _ask(owners: int):
    def ask(table: pa.Table) -> pa.Table:
        keys = np.unique(table.column("fp").to_numpy().astype(np.uint64))
        who, cuts = X.split(keys, owners)
        coded, sizes = [], []
        for o, a, b in zip(who, cuts[:-1], cuts[1:]):
            floor = np.uint64((int(o) << 64) // owners)
            r, unary, rest = rice_encode(keys[a:b] - np.minimum(floor, keys[a]))
            coded.append(bytes([r]) + len(unary).to_bytes(4, "little") + unary + rest)
            sizes.append(int(b - a))
        bucket = table.column(X.BUCKET)[0].as_py()
        return pa.table([pa.array(np.full(len(who), bucket), pa.int32()), pa.array(who, pa.int32()), pa.array(sizes, pa.int32()), pa.array(coded, pa.binary()), pa.nulls(len(who), pa.binary())], schema=X.ASK_SCHEMA)

    return ask


def _decode(n: int, blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[1:5], "little")
    return rice_decode(n, blob[0], blob[5 : 5 + size], blob[5 + size :])


def _own(table: pa.Table) -> pa.Table:
    sizes = table.column("n").to_pylist()
    keys = [_decode(n, blob) for n, blob in zip(sizes, table.column("keys").to_pylist())]
    _, which, count = X.inverse_counts(np.concatenate(keys))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return X.answers(table, [np.packbits(count[which[a:b]] > 1).tobytes() for a, b in zip(cuts[:-1], cuts[1:])])


def _suspects(table: pa.Table, said: pa.Table) -> pa.Table:
    """The bucket's fingerprints that others have too, or it has twice; each once."""
    schema = pa.schema([("fp", pa.int64())])
    if not table.num_rows:
        return schema.empty_table()
    keys, _, count = X.inverse_counts(table.column("fp").to_numpy().astype(np.uint64))
    return pa.table([pa.array(keys[X.bits(said) | (count > 1)].astype(np.int64))], schema=schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; texts are equal when their bytes are.

    A null text is empty. keep_id is the group's largest doc_id; group_size counts rows. Rows that repeat both doc_id and
    text are copies in one group and share `kept`. A null doc_id is smaller than any other and stays only if the
    group has no other. Other columns are ignored.
    """
    text = F.coalesce(F.col(X.TEXT), F.lit(""))
    full = X.corpus(docs).withColumn(X.TEXT, text).withColumn("fp", F.xxhash64(X.TEXT))
    # of many small documents the count sets the number of buckets, of few large ones nothing needs to be large
    buckets = max(1, -(-docs.count() // KEYS_EACH), min(8, docs.sparkSession.sparkContext.defaultParallelism))
    slim = X.bucketed(docs, buckets).withColumn("fp", F.xxhash64(F.coalesce(F.col(X.TEXT), F.lit("")))).select(X.DOC, "fp", X.BUCKET)
    said = X.owned(slim.groupBy(X.BUCKET).applyInArrow(_ask(buckets), X.ASK), _own)
    suspects = X.cut(slim.groupBy(X.BUCKET).cogroup(said.groupBy(X.BUCKET)).applyInArrow(_suspects, "fp long"))
    # byte verification: suspects are grouped by the text itself; map-side, so copies collapse before they travel
    texts = full.where(X.sieve(suspects, "fp")(F.col("fp")))
    groups = texts.groupBy("fp", X.TEXT).agg(F.max(X.DOC).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = X.cut(groups.select("fp", F.sha2(X.TEXT, 256).alias("sha"), "keep_id", "group_size").where("group_size > 1"))
    out = full.select(X.DOC, F.sha2(X.TEXT, 256).alias("text_sha256"))
    return attach(out, groups.select(F.col("sha").alias("text_sha256"), "keep_id", "group_size"), "text_sha256", "group_size").select(
        X.DOC,
        F.when(F.col("group_size").isNull(), F.col(X.DOC)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col(X.DOC).eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


HOT_ROWS = 100_000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, limit: int | None = None) -> DataFrame:
    """Left join of rows to one row for each key. Keys of more than `limit` rows (HOT_ROWS) are at most rows / limit many, so
    these are broadcast; the others are shuffled, and none of them is large."""
    limit = HOT_ROWS if limit is None else limit
    hot = groups.where(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, key, "left")
    cold = groups.where(F.col(size) <= limit)
    first = rows.join(F.broadcast(hot), key, "left")
    others = [c for c in groups.columns if c != key]
    return first.where(F.col(size).isNotNull()).unionByName(first.where(F.col(size).isNull()).drop(*others).join(cold, key, "left"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those of which an equal text with a larger doc_id stays; of rows that
    repeat both doc_id and text, one stays."""
    marks = exact_groups(docs).where("group_size > 1").groupBy(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_sha")).agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    marks = X.cut(marks.withColumn("_h", F.xxhash64("_d", "_sha")))
    sha = F.sha2(F.coalesce(F.col(X.TEXT).cast("string"), F.lit("")), 256)
    match = F.col("_d").eqNullSafe(F.col(X.DOC)) & (F.col("_sha") == sha)
    out = X.left_out(docs, marks.where("not _kept"), F.xxhash64(F.col(X.DOC).cast("long"), sha), match, "_h")
    again = marks.where("_kept and _n > 1")
    if again.isEmpty():
        return out
    return out.join(again, match, "left_anti").unionByName(out.join(again, match, "left_semi").dropDuplicates([X.DOC, X.TEXT]))
