"""Audio files as rows of mono samples at their own rate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import EngineConfig
from .audio_formats import read_uncompressed

AUDIO = "audio_id long, path string, sr int, samples array<double>"


def read_audio(spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), decode: Callable[[bytes], tuple[np.ndarray, int]] = read_uncompressed, errors: bool = False) -> DataFrame:
    """(audio_id, path, sr, samples) of the audio files under ``path``.

    ``decode`` turns a file's bytes into mono samples and their rate; one of one's
    own reads other formats. Files that are larger than the upload cap, cannot be
    decoded or are shorter than a second give no row; with ``errors`` they give
    one without samples, whose further column ``error`` says which.
    """
    files = spark.read.format("binaryFile").load(path)
    small = F.when(F.col("length") <= config.max_upload_bytes, F.col("content"))

    def read(content: bytes | None) -> tuple[int | None, list[float] | None, str | None]:
        if content is None:
            return None, None, "too large"
        try:
            y, sr = decode(content)
        except (EOFError, ValueError) as e:
            return None, None, f"cannot be decoded: {e}"
        return (int(sr), y.tolist(), None) if len(y) >= config.min_seconds * sr else (int(sr), None, "too short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sr, samples, error = read(content.as_py())
                if errors or error is None:
                    yield pa.record_batch([pa.array([name]), pa.array([sr], pa.int32()), pa.array([samples], pa.list_(pa.float64())), pa.array([error], pa.string())], ["path", "sr", "samples", "error"])

    found = files.select("path", small.alias("content")).mapInArrow(run, "path string, sr int, samples array<double>, error string")
    return found.select(F.xxhash64("path").alias("audio_id"), "path", "sr", "samples", *(["error"] if errors else []))
