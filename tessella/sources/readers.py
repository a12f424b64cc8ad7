"""Image files as packed rows, and packed rows as image files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import codecs
from .synthetic import _ARROW

SUFFIXES = "pnm|pgm|ppm|pbm|pam|png|jpg|jpeg|npy|tmp"


def decode_files(files: DataFrame) -> DataFrame:
    """Rows of Spark's binaryFile source as packed gray images; unreadable ones keep a status and null data."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    a = codecs.decode_gray(content or b"", path.rsplit(".", 1)[-1])
                    rows.append({"image_id": path, "width": a.shape[1], "height": a.shape[0], "channels": 1, "data": np.ascontiguousarray(a).tobytes(), "status": "ok"})
                except (codecs.FormatError, ValueError, IndexError, KeyError, StopIteration) as e:
                    rows.append({"image_id": path, "width": None, "height": None, "channels": None, "data": None, "status": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    known = files.where(F.lower("path").rlike(rf"\.({SUFFIXES})$"))
    return known.select("path", "content").mapInArrow(run, schema.IMAGES)


def read_images(spark: SparkSession, *paths: str) -> DataFrame:
    return decode_files(spark.read.format("binaryFile").load(list(paths)))


def rejects(images: DataFrame) -> DataFrame:
    return images.where("status <> 'ok'").select("image_id", "status")


def encode_images(images: DataFrame, suffix: str = "png") -> DataFrame:
    """(image_id, content): the bytes of an image file for each packed gray image."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            content = [codecs.encode(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]), suffix) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["image_id"] for r in rows], pa.string()), pa.array(content, pa.binary())], names=["image_id", "content"])

    return images.where(F.col("data").isNotNull()).select("image_id", "width", "height", "data").mapInArrow(run, "image_id string, content binary")


def write_images(images: DataFrame, folder: str, suffix: str = "png") -> None:
    """Write one file for each image to a folder that all executors share; names are the image ids, made safe."""

    def save(batches):
        import os
        import re

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", name)
                path = os.path.join(folder, f"{safe}.{suffix}")
                with open(f"{path}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.part", path)  # a repeated task writes the same file again
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    encode_images(images, suffix).mapInArrow(save, "n bigint").agg(F.sum("n")).collect()


def postscript(images: DataFrame) -> DataFrame:
    """(image_id, ps): each image as a PostScript fragment, pixels in hexadecimal."""
    head = F.format_string("/picstr %d string def\n%d %d 8 [1 0 0 1 0 0]\n{currentfile picstr readhexstring pop}\nimage\n", "width", "width", "height")
    return images.where(F.col("data").isNotNull()).select("image_id", F.concat(head, F.lower(F.hex("data")), F.lit("\n")).alias("ps"))
