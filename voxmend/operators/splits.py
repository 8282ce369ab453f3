"""Splits and limits of record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmend.operators.evidence import text_field


def by_field(df: DataFrame, path: str = "split") -> DataFrame:
    """df with column bucket: the field's text, unknown where it is missing or empty."""
    found = text_field(df, path)
    return df.withColumn("bucket", F.when(found == "", "unknown").otherwise(found))


def order_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def by_hash(df: DataFrame, key: str, seed: int = 23, train: float = 0.9, dev: float = 0.05) -> DataFrame:
    """df with column bucket: train, dev and test of exact sizes int(n * train), int(n * dev) and the rest, in the order of
    md5(seed:key), then key. The same on every run and cluster.

    Ranks come from counts: keys fall into 4096 ranges of the hash, whose sizes are added up; only a range is sorted.
    """
    placed = df.withColumn("_h", order_key(seed, F.col(key))).withColumn("_range", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    # sizes has 4096 rows at most.
    ranked = placed.withColumn("_local", local).join(F.broadcast(sizes), "_range").withColumn("_rank", F.col("_before") + F.col("_local"))
    first = F.floor(F.col("_total") * F.lit(float(train)))
    second = first + F.floor(F.col("_total") * F.lit(float(dev)))
    bucket = F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= second, "dev").otherwise("test")
    return ranked.withColumn("bucket", bucket).select(*(f"`{c}`" for c in df.columns), "bucket")


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in the given order; 0 is all of them."""
    return df.orderBy(order).limit(n) if n else df
