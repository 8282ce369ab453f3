"""Kaldi lists and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmend.functions.text import SPACE_CLASS, strip
from voxmend.sources.jsonl import numbered_lines, told


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """id, value, ord of a list of 'id value' lines, a byte order mark allowed. Of lines with one id the last value counts, in
    the place of the first. A line without a value fails the query with its file and number. ord is the line's number."""
    lines = numbered_lines(spark, path).select("file", "line_no", F.col("line_no").alias("ord"), F.regexp_replace("line", "^\\x{FEFF}", "").alias("line"))
    return pairs(lines, told("expected 'id value'"))


def pairs(lines: DataFrame, problem: Column | None = None) -> DataFrame:
    """As read_pairs, of rows (ord, line); problem is what a line without a value fails with."""
    line = strip(F.col("line"))
    form = rf"(?s)^([^{SPACE_CLASS}]+)[{SPACE_CLASS}]+(.+)$"
    named = F.regexp_extract(line, form, 1)
    failed = F.raise_error(F.concat(F.lit("expected 'id value': "), line) if problem is None else problem).cast("string")
    read = lines.where(line != "").select("ord", F.when(named == "", failed).otherwise(named).alias("id"), F.regexp_extract(line, form, 2).alias("value"))
    return read.groupBy("id").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))


def manifest(transcripts: DataFrame, recordings: DataFrame | None = None, audio_dir: str = "", audio_ext: str = ".wav") -> DataFrame:
    """id, audio, reference of transcripts (id, value): the recording's path (recordings id, value), else
    audio_dir/id + audio_ext, else empty. Transcripts without a recording stay; recordings alone don't."""
    fallback: Column = F.concat(F.lit(audio_dir.rstrip("/") + "/"), F.col("t.id"), F.lit(audio_ext)) if audio_dir else F.lit("")
    if recordings is None:
        return transcripts.alias("t").select("t.id", fallback.alias("audio"), F.col("t.value").alias("reference"))
    met = transcripts.alias("t").join(recordings.alias("r"), F.col("t.id") == F.col("r.id"), "left")
    return met.select(F.col("t.id").alias("id"), F.coalesce("r.value", fallback).alias("audio"), F.col("t.value").alias("reference"))


def existing(found: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose audio is empty or among files (path), rows whose audio is missing)."""
    paths = files.select(F.col("path").alias("_path")).distinct()
    there = found.where("audio = ''").unionByName(found.where("audio <> ''").join(paths, F.col("audio") == F.col("_path"), "left_semi"))
    return there, found.where("audio <> ''").join(paths, F.col("audio") == F.col("_path"), "left_anti")
