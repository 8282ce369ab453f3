"""Audio files: their bytes by path, and the samples of PCM recordings."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What recognition models listen to.
SAMPLE_RATE = 16000

Loader = Callable[[bytes], tuple[np.ndarray, int]]


def read_files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """path, content of the files under path whose names match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def pcm(content: bytes) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1, one row a channel; rate) of a WAV file of 8, 16 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    if width not in (1, 2, 4):
        raise ValueError(f"samples of {8 * width} bits need a loader of their own")
    raw = np.frombuffer(data, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    return ((raw - 128) / 128 if width == 1 else raw / float(1 << (8 * width - 1))).reshape(-1, channels).T, rate


def mono(samples: np.ndarray, rate: int, wanted: int = SAMPLE_RATE) -> np.ndarray:
    """One channel at the wanted rate, by the mean of channels and straight lines between samples."""
    one = np.asarray(samples, np.float32).reshape(-1, np.shape(samples)[-1]).mean(axis=0)
    if rate == wanted or not len(one):
        return one
    return np.interp(np.arange(len(one) * wanted // rate) * rate / wanted, np.arange(len(one)), one).astype(np.float32)


def samples(files: DataFrame, load: Loader = pcm, rate: int = SAMPLE_RATE) -> DataFrame:
    """files (path, content) with samples array<float>, mono at the rate; load reads other formats than PCM."""

    @F.pandas_udf("array<float>")
    def heard(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: mono(*load(c), rate))

    return files.select("path", heard("content").alias("samples"))
