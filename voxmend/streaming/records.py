"""Record transforms over streams of JSON lines. They keep no state, so a stream runs the same plan as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the records in JSON-lines files as they appear under path; lines that are no records give nulls."""
    lines = spark.readStream.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def start(records: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the transformed records as Parquet under path, each input file once; once: what is there now, then it ends."""
    writer = transform(records).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(records: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by key over windows of event time, with rows up to late accepted."""
    return records.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
