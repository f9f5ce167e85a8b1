"""Row numbers over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.corpus import scratch


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with a column `name`: 0, 1, ... in the given order.

    Sorted ranges are written to the shared folder with their number, so a lost task can't change them; their sizes, one row a range, say
    where each begins.
    """
    spark = df.sparkSession
    home = scratch(spark, "numbered")
    df.orderBy(*order).withColumn("_range", F.spark_partition_id()).write.parquet(home)
    kept = spark.read.parquet(home)
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return kept.join(starts, "_range").withColumn(name, (F.col("_start") + within).cast("long")).drop("_range", "_start")
