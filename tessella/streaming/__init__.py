"""Endless image sources: the batch detector applied to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import DetectorConfig
from ..plans.detect import detect
from ..sources.readers import decode_files

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def image_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New image files of a folder as they come, decoded."""
    return decode_files(spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder))


def detect_stream(frames: DataFrame, cfg: DetectorConfig, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "30 milliseconds"):
    """Start a query that gives each micro-batch's detections to ``sink(detections, batch_id)``.

    Detection keeps no state between frames, so no watermark is needed; a batch that is tried again gives the same rows.
    """
    return frames.writeStream.foreachBatch(lambda batch, i: sink(detect(batch, cfg), i)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
