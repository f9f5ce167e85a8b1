"""Op 4. Repeated lines: explode, hash, count documents, drop, reassemble by position. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .exact_dedup import HOT_ROWS

BLANK = " \t\n\x0b\x0c\r"
ROW = ["d", "t"]  # doc_id and a hash of the text: rows that repeat a doc_id may differ


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() is far cheaper than translate(), and the same where all is ASCII
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops the lines whose key has at least min_chars code points and is found in at least min_docs documents,
    except in the largest doc_id that holds the key.

    Lines are split at \\n; a null or empty text is one empty line. Keys are compared by 128 bits of hash. Returns doc_id,
    n_lines (before dropping), n_dropped and kept_text, one row for each input row. Rows that repeat a doc_id count as
    one document, and each loses or keeps its own lines; a null doc_id counts as one document, the smallest. Other columns are ignored.
    """
    full = X.corpus(docs).withColumn(X.TEXT, F.coalesce(F.col(X.TEXT), F.lit("")))
    full = full.withColumn("d", F.coalesce(F.col(X.DOC), F.lit(-(2**63)))).withColumn("t", F.xxhash64(X.TEXT))
    parted = F.split(F.col(X.TEXT), "\n", -1)
    lines = full.select(*ROW, F.posexplode(parted).alias("pos", "line")).where(F.octet_length("line") >= min_chars)
    keyed = lines.select(*ROW, "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = X.cut(keyed.select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2")))
    keys = hashed.groupBy("h1", "h2").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).where(f"n >= {min_docs} and lo < hi")
    # n counts lines; those that a document repeats make it too large, so the few keys left are counted exactly
    keys = X.cut(keys)
    several = _semi(hashed, keys)
    bad = several.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("hi")).where(f"n >= {min_docs}")
    # repeated rows give each of their places again
    drops = _with_last(several, bad).where("d < hi").groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    drops = X.cut(drops.select(*ROW, F.size("drops").alias("n_drops"), _mask(F.col("drops")).alias("mask")).withColumn("h", F.xxhash64(*ROW)))
    # texts without drops stay where they are
    may = X.sieve(drops, "h")(F.xxhash64(*ROW))
    whole = full.where(~may).select("*", F.lit(None).cast("int").alias("n_drops"), F.lit(None).cast("binary").alias("mask"))
    rows = whole.unionByName(full.where(may).join(drops.drop("h"), ROW, "left").select(whole.columns))
    kept = F.filter(parted, lambda _, i: F.substring(F.col("mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    none = F.col("mask").isNull()
    return rows.select(
        X.DOC,
        (F.length(X.TEXT) - F.length(F.replace(F.col(X.TEXT), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(F.col("n_drops")).cast("long").alias("n_dropped"),
        F.when(none, F.col(X.TEXT)).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def _mask(places: Column) -> Column:
    """A byte for each line up to the last place: "1" at the places (sorted, from 0), "0" elsewhere. A look into it takes the same
    time however many there are."""
    before = F.concat(F.array(F.lit(-1)), places)
    runs = F.zip_with(places, F.slice(before, 1, F.size(places)), lambda p, q: F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1")))
    return F.array_join(runs, "").cast("binary")


def _semi(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with a key of `keys`; keys of many rows are few by count and broadcast."""
    if keys.where(f"n > {HOT_ROWS}").isEmpty():
        return rows.join(keys.select("h1", "h2"), ["h1", "h2"], "left_semi")
    hot = F.broadcast(keys.where(f"n > {HOT_ROWS}").select("h1", "h2"))
    cold = keys.where(f"n <= {HOT_ROWS}").select("h1", "h2")
    return rows.join(hot, ["h1", "h2"], "left_semi").unionByName(rows.join(hot, ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"], "left_semi"))


def _with_last(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows with their key's largest document; see _semi."""
    bad = X.cut(bad)
    if bad.where(f"n > {HOT_ROWS}").isEmpty():
        return rows.join(bad.select("h1", "h2", "hi"), ["h1", "h2"])
    hot = F.broadcast(bad.where(f"n > {HOT_ROWS}").select("h1", "h2", "hi"))
    cold = bad.where(f"n <= {HOT_ROWS}").select("h1", "h2", "hi")
    return rows.join(hot, ["h1", "h2"]).unionByName(rows.join(cold, ["h1", "h2"]))
