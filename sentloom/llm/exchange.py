"""How the operators of this package meet across partitions.

A *bucket* is a fixed function of doc_id, so that a recomputed task always sees the same rows. Buckets send sorted
keys to *owners* (a function of the key), each key once however often the bucket has it; owners return one bit or
number for each key, in the order in which it came. A key that a third of all texts hold thus reaches its owner once
a bucket, and no group grows with a key's frequency. The exchange of the texts is the same in every round of one
query, so Spark runs it once and reuses it.
"""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U, mix

BUCKET_BYTES = 16 << 20
DOC, TEXT, BUCKET = "doc_id", "text", "_bucket"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is set only where none is named and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "sentloom-checkpoints"))
    return named or jsc.getCheckpointDir().get()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _set(spark: SparkSession, name: str, value: str | None) -> str | None:
    old = spark.conf.get(name, None)
    spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return old


def _kept(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    shared_dir(spark)
    old = _set(spark, CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint(eager=True)  # a plan takes the setting of the moment when it is made
        _made.append(_path(kept))
        return kept
    finally:
        _set(spark, CLEANUP, old)


_made: list[str] = []  # files of kept tables, in the order in which they were made


def mark() -> int:
    """A point in time for forget()."""
    return len(_made)


def forget(spark: SparkSession, since: int) -> None:
    """Deletes the kept tables made since mark(): for a caller that has written what came of them."""
    for path in _made[since:]:
        _delete(spark, path)
    del _made[since:]


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, without lineage. Shuffle files that led there go as soon as the rows are kept.

    Nor does the plan know what sizes were estimated before: a loop of joins would square the estimate in each round.
    """
    spark, kept = df.sparkSession, _kept(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().logical().rdd(), kept.schema(), False), spark)


def _path(kept: DataFrame) -> str:
    return kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get()


def release(kept: DataFrame) -> None:
    """Deletes the files of a table that cut() made and nothing reads any more."""
    path = _path(kept)
    if path in _made:
        _made.remove(path)
    _delete(kept.sparkSession, path)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """Like cut(), parted by key, so that later groupings by key needn't move these rows. Spark notes how a kept table is parted
    only where its plan was final from the start, so adaptive planning is off for this one step."""
    spark = df.sparkSession
    old = _set(spark, "spark.sql.adaptive.enabled", "false")
    try:
        return _kept(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        _set(spark, "spark.sql.adaptive.enabled", old)


SIEVE_BITS = 1 << 28  # 32 MB is the most that goes to every task
SEGMENT = 1 << 15  # words of a sieve that one task sets


def _bits_of(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, its two bits) of each key."""
    x = mix(keys.astype(np.int64).view(U))
    return ((x >> U(32)) * U(words) >> U(32)).astype(np.int64), (U(1) << (x & U(63))) | (U(1) << ((x >> U(6)) & U(63)))


def sieve(keys: DataFrame, column: str):
    """A filter for rows: Column of a long -> Column that is true for all keys in `column` of keys, and for few others.

    It is a Bloom filter of 16 bits a key, made in segments on the executors. Its size is bounded; with so many keys that it would be
    full, more and at last all rows pass. So it only saves shuffling: what passes is still joined.
    """
    keys = keys.select(F.col(column).cast("long").alias("k"))
    n = keys.count()
    if n > SIEVE_BITS // 2:
        return lambda c: F.lit(True)
    words = max(SEGMENT, min(SIEVE_BITS, 1 << (16 * n).bit_length()) // 64)

    def place(batches):
        for batch in batches:
            word, _ = _bits_of(batch.column(0).to_numpy(), words)
            yield pa.RecordBatch.from_arrays([pa.array(word // SEGMENT, pa.int32()), batch.column(0)], names=["segment", "k"])

    def build(table: pa.Table) -> pa.Table:
        word, bits = _bits_of(np.unique(table.column("k").to_numpy()), words)
        out = np.zeros(SEGMENT, U)
        np.bitwise_or.at(out, word % SEGMENT, bits)
        return pa.table([table.column("segment").slice(0, 1), pa.array([out.tobytes()], pa.binary())], names=["segment", "bits"])

    made = np.zeros(words, U)
    for r in keys.mapInArrow(place, "segment int, k long").groupBy("segment").applyInArrow(build, "segment int, bits binary").toLocalIterator():
        made[r["segment"] * SEGMENT :][:SEGMENT] = np.frombuffer(r["bits"], U)
    shared = keys.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("boolean")
    def passes(k: pd.Series) -> pd.Series:
        word, bits = _bits_of(k.to_numpy(), words)
        return pd.Series(shared.value[word] & bits == bits)

    return lambda c: passes(c)


def left_out(rows: DataFrame, gone: DataFrame, key: Column, match: Column, column: str) -> DataFrame:
    """rows without those that match a row of gone. key: a long of each row, equal to `column` of gone where they match. Rows
    that the sieve stops stay where they are; only the others are shuffled."""
    may = sieve(gone, column)
    return rows.where(~may(key)).unionByName(rows.where(may(key)).join(gone, match, "left_anti"))


def corpus(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text and nothing else, whatever other columns there are."""
    return docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT).cast("string").alias(TEXT), *more)


def buckets_for(docs: DataFrame, bytes_each: int = BUCKET_BYTES) -> int:
    """Number of buckets, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    return max(1, math.ceil(total / bytes_each))


def bucketed(docs: DataFrame, n: int) -> DataFrame:
    """Rows with their bucket. The exchange of one plan on it is shared by all uses within a query."""
    return corpus(docs).withColumn(BUCKET, F.pmod(F.xxhash64(F.coalesce(F.col(DOC), F.lit(-(2**62)))), F.lit(n)).cast("int"))


ASK = "_bucket int, owner int, n int, keys binary, extra binary"
ANSWER = "_bucket int, owner int, n int, answer binary"
ASK_SCHEMA = pa.schema([("_bucket", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
ANSWER_SCHEMA = pa.schema([("_bucket", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("answer", pa.binary())])


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of the key space, so sorted keys are sorted by owner too."""
    return (((keys >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def split(keys: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner numbers, cuts) of sorted keys; keys[cuts[i]:cuts[i+1]] go to the i-th of these owners."""
    who = owner_of(keys, owners)
    cuts = np.flatnonzero(np.diff(who, prepend=-1))
    return who[cuts] if len(cuts) else who[:0], np.append(cuts, len(keys))


def asks(bucket: int, keys: np.ndarray, owners: int, extra: np.ndarray | None = None) -> pa.Table:
    """Sorted distinct keys of a bucket as rows for their owners; extra: one fixed-width value for each key."""
    who, cuts = split(keys, owners)
    pairs = list(zip(cuts[:-1], cuts[1:]))
    return pa.table([
        pa.array(np.full(len(who), bucket), pa.int32()), pa.array(who, pa.int32()), pa.array(np.diff(cuts), pa.int32()),
        pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary()),
        pa.array([None if extra is None else extra[a:b].tobytes() for a, b in pairs], pa.binary()),
    ], schema=ASK_SCHEMA)


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(all keys in the order of the rows, the row cuts, the extras)."""
    blobs = table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(blobs), np.uint64)
    cuts = np.concatenate([[0], np.cumsum(table.column("n").to_numpy())]).astype(np.int64)
    return keys, cuts, table.column("extra").to_pylist()


def answers(table: pa.Table, per_key: list[bytes]) -> pa.Table:
    return pa.table([table.column("_bucket").cast(pa.int32()), table.column("owner").cast(pa.int32()), table.column("n").cast(pa.int32()), pa.array(per_key, pa.binary())], schema=ANSWER_SCHEMA)


def by_owner(table: pa.Table) -> list[tuple[int, bytes]]:
    """(n, answer) of a bucket's answers in the order of its keys."""
    order = np.argsort(table.column("owner").to_numpy(), kind="stable")
    n, blobs = table.column("n").to_numpy(), table.column("answer").to_pylist()
    return [(int(n[i]), blobs[i]) for i in order]


def bits(table: pa.Table) -> np.ndarray:
    """Answers of one bit a key, for all sorted keys of the bucket."""
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for n, x in by_owner(table)]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def owned(asked: DataFrame, fn) -> DataFrame:
    """fn: (table of one owner) -> answers()."""
    return asked.groupBy("owner").applyInArrow(fn, ANSWER)


def inverse_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, number of the key at each place, rows of each key)."""
    return np.unique(keys, return_inverse=True, return_counts=True)
