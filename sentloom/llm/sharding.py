"""Op 10. Contiguous balanced shards from global prefix sums of byte sizes.

Rows are put in a global order (fingerprint of the text, then doc_id: equal texts are neighbours) in ranges. Each
range gives its total alone to the driver; the totals' prefix sums say where it starts, and cuts at equal targets
say which shard each group of equal texts is in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from . import exchange as X
from .exact_dedup import attach

ROWS_EACH = 1 << 20


def byte_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row: shards of near equal bytes.

    size is the text's UTF-8 bytes (null: none) plus 1. The order is that of the texts' fingerprints, so equal texts lie
    together and are never parted: a group goes to the shard in which its middle byte falls, and a shard's size
    differs from the target by no more than half the groups at its two ends. A null text is equal to an empty one. slot counts a shard's
    rows from 0; rows that tie (same doc_id and text) take successive slots. Other columns are ignored.
    """
    text = F.coalesce(F.col(X.TEXT), F.lit(""))
    slim = X.corpus(docs).select(X.DOC, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    # equal texts, first: one row a group, combined before the shuffle, so that the prefix sums run over groups and a hot group is one number
    slim = X.cut(slim)
    n = slim.count()
    ranges = max(1, -(-n // ROWS_EACH))
    order = slim.withColumn("part", (F.shiftright(F.col("h"), 32).cast("long") + 2**31) * ranges)
    # fingerprints are uniform, so equal ranges of them are balanced but for copies; a hot group spreads by doc_id within its range
    order = order.withColumn("part", F.shiftrightunsigned("part", 32).cast("int"))
    groups = X.cut(order.groupBy("part", "h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    totals = [(0, 0, 0)] * ranges
    for r in groups.groupBy("part").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).toLocalIterator():
        totals[r["part"]] = (r["b"], r["r"], 1)
    before = np.concatenate([[[0, 0]], np.cumsum([[b, r] for b, r, _ in totals], axis=0)]).astype(np.int64)
    total = int(before[-1, 0])
    schema = pa.schema([("h", pa.int64()), ("rows", pa.int64()), ("shard", pa.int32()), ("first", pa.int64())])

    def place(table: pa.Table) -> pa.Table:
        base_bytes, base_rows = before[table.column("part")[0].as_py()]
        h, size, rows = (table.column(c).to_numpy() for c in ("h", "bytes", "rows"))
        o = np.argsort(h, kind="stable")
        h, size, rows = h[o], size[o], rows[o]
        start = base_bytes + np.cumsum(size) - size
        # the middle of the group, in integers: (start + size / 2) * shards / total
        shard = np.array([min(shards - 1, (2 * s + z) * shards // (2 * total)) for s, z in zip(start.tolist(), size.tolist())], np.int32)
        return pa.table([pa.array(h), pa.array(rows), pa.array(shard), pa.array(base_rows + np.cumsum(rows) - rows)], schema=schema)

    placed = X.cut(groups.groupBy("part").applyInArrow(place, "h long, rows long, shard int, first long"))
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("first").alias("zero")))  # one row a shard
    placed = placed.join(starts, "shard").select("h", "rows", "shard", (F.col("first") - F.col("zero")).alias("slot"))
    rows = _join(slim, placed, "h")
    return rows.select(X.DOC, "size", "text_crc32", "shard", (F.col("slot") + F.col("nth")).alias("slot"))


def _join(slim: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Rows with their group's place and their number within the group. Groups of one row need no numbering; those of
    several are numbered in chunks of doc_id hashes, whose counts are summed first, so no group is one task."""
    rows = attach(slim, placed, key, "rows")
    single = rows.where("rows = 1").withColumn("nth", F.lit(0).cast("long"))
    many = rows.where("rows > 1").withColumn("_chunk", F.pmod(F.xxhash64(X.DOC), F.greatest(F.lit(1), F.ceil(F.col("rows") / 10_000)).cast("long")))
    counts = many.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select(key, "_chunk", (F.sum("c").over(W.partitionBy(key).orderBy("_chunk")) - F.col("c")).alias("_off"))
    inner = many.withColumn("_nth", F.row_number().over(W.partitionBy(key, "_chunk").orderBy(X.DOC)) - 1)
    numbered = inner.join(offsets, [key, "_chunk"]).withColumn("nth", F.col("_nth") + F.col("_off"))
    return single.unionByName(numbered.drop("_chunk", "_nth", "_off"))
