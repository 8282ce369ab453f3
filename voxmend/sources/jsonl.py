"""JSON lines: one object a line, read strictly or leniently, written compactly."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from voxmend.functions.text import has_text


def _problem(lines: pd.Series) -> pd.Series:
    def one(line: str) -> str | None:
        try:
            return None if isinstance(json.loads(line), dict) else "expected JSON object"
        except ValueError:
            return "invalid JSON"

    return lines.map(one)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file of every line that has more than white space."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.where(has_text(F.col("line")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file, line_no (from 1) of every line, blank ones too.

    Files are read in blocks, by any task, so a line's number is its place in its block and the lines of the blocks
    before it: a scan that only counts, one row a block, joined to the scan that reads.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).alias("block")
    lines = spark.read.text(path).select(F.col("value").alias("line"), block, F.monotonically_increasing_id().alias("place"))
    sizes = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("block.file").orderBy("block.at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("block").alias("b"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    met = lines.join(starts, F.col("block") == F.col("b"))
    return met.select("line", F.col("block.file").alias("file"), (F.col("place") + F.col("shift")).alias("line_no"))


def told(problem: Column | str) -> Column:
    """file:line_no: problem."""
    said = F.lit(problem) if isinstance(problem, str) else problem
    return F.concat(F.regexp_replace("file", "^file:/+", "/"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), said)


def read(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """The records of JSON-lines files under a schema; blank lines don't count. strict: any line that is no JSON object fails
    the query with its file, number and problem, by Python's reading of JSON (the JVM's takes trailing junk). Not strict:
    such lines give rows of nulls."""
    kind = schema if isinstance(schema, str) else schema.json()
    if not strict:
        return read_lines(spark, path).select(F.from_json("line", kind).alias("r")).select("r.*")
    lines = numbered_lines(spark, path).where(has_text(F.col("line")))
    checked = lines.withColumn("_problem", F.pandas_udf(_problem, "string")("line"))
    line = F.when(F.col("_problem").isNotNull(), F.raise_error(told(F.col("_problem"))).cast("string")).otherwise(F.col("line"))
    return checked.select(F.from_json(line, kind).alias("r")).select("r.*")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """value variant, file of every line that is not blank, whatever JSON it is; a line that is none fails the query."""
    return read_lines(spark, path).select(F.parse_json("line").alias("value"), "file")


def as_lines(df: DataFrame) -> DataFrame:
    """value: each row as compact JSON, nulls written out, fields in column order."""
    return df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write(df: DataFrame, path: str) -> int:
    """Writes JSON lines over what is at path, and returns their number, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    as_lines(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return int(seen.get["n"])


def write_analysis(rows: DataFrame, path: str, k: int = 20, order: str = "id") -> DataFrame:
    """Writes the k largest changes of each status (status=<name> folders) and a summary of statuses and reasons under path."""
    from voxmend.operators.reports import reason_counts, status_counts, top_changes

    write_buckets(top_changes(rows, k, order), f"{path}/changes", "status")
    summary = status_counts(rows).select(F.lit("status").alias("kind"), F.col("status").alias("name"), F.col("samples").alias("n"))
    summary = summary.unionByName(reason_counts(rows, order).select(F.lit("reason").alias("kind"), F.col("reason").alias("name"), "n"))
    write(summary.coalesce(1), f"{path}/summary")
    return summary


def write_buckets(df: DataFrame, path: str, bucket: str = "bucket") -> DataFrame:
    """Writes one folder of JSON lines a bucket (bucket=<name>), in one pass; returns bucket and records, by name."""
    rest = [c for c in df.columns if c != bucket]
    lines = df.select(F.to_json(F.struct(*(f"`{c}`" for c in rest)), {"ignoreNullFields": "false"}).alias("value"), F.col(bucket).alias("bucket"))
    lines.write.mode("overwrite").partitionBy("bucket").text(path)
    return df.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("records")).orderBy("bucket")
