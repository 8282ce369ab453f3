"""Shared pieces: reading tables, cutting lineage in the shared folder, laying texts out for numpy."""

from __future__ import annotations

import contextlib
import ctypes
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever an operator counts words: a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine, one of our own where it is
    unset. On a cluster without that setting it raises: a folder of the driver's is none of the executors'."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept.rstrip("/")
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="voxmend-")
        spark.sparkContext.setCheckpointDir(where)
        where = f"file://{where}"
    return where.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/voxmend-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables that written left in this application's folder; results that still read them must be saved first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast of any value, read by calling the result. The value's classes travel along (see voxmend.llm), which a
    plain broadcast leaves behind: executors have no copy of this library."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(data.value)


def worker_memory() -> dict[Any, Any]:
    """What this Python process keeps from task to task: functions arrive by value, with new globals each time."""
    return sys.modules.setdefault("_voxmend_worker_memory", types.ModuleType("_voxmend_worker_memory")).__dict__


def let_go() -> None:
    """Drops what an earlier operator left in this process (see worker_memory): tasks of the next one need the room."""
    kept = worker_memory()
    for name in ("definition", "encoder"):
        kept.pop(name, None)
    give_back()


def give_back() -> None:
    """Returns to the system what this process has freed: allocators keep it otherwise, and the next operator's comes on top."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types; extra columns, whatever they are called, stay behind."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def plain_strings(column: pa.Array) -> pa.Array:
    """An Arrow string column without nulls (null: empty), with 64-bit offsets that start at 0: Arrow's string functions
    misread an array that a cast of a slice leaves with a later start."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.offset:
        column = column.take(pa.array(range(len(column))))
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def one_thread() -> None:
    """Libraries with thread pools of their own keep to the one core that a Spark task has."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
