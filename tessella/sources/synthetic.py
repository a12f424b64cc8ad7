"""Scenes with known contents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import schema
from .families import Family, family


def marker(f: Family, code_id: int) -> np.ndarray:
    """A marker, one pixel a cell."""
    n = f.total_width
    im = np.zeros((n, n), np.uint8)
    ring = f.width_at_border + (0 if f.reversed_border else 2)
    a = (n - ring) // 2
    z = a + ring - 1
    im[[a, z], a : z + 1] = 255
    im[a : z + 1, [a, z]] = 255
    off = (n - f.width_at_border) // 2
    for i, (x, y) in enumerate(f.bits):
        if f.codes[code_id] >> (f.nbits - 1 - i) & 1:
            im[y + off, x + off] = 255
    return im


def scene(f: Family, code_id: int, cell: int = 10, pad: int = 30, turns: int = 0, background: int = 200) -> np.ndarray:
    im = np.pad(np.kron(marker(f, code_id), np.ones((cell, cell), np.uint8)), pad, constant_values=background)
    return np.ascontiguousarray(np.rot90(im, turns))


def scenes(spark: SparkSession, name: str, cell: int = 10, pad: int = 30) -> DataFrame:
    """Packed images of every marker of a family at each quarter turn, drawn on the executors."""
    f = family(name)

    def draw(batches):
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                im = scene(f, k // 4, cell, pad, k % 4)
                rows.append({"image_id": f"{name}-{k // 4}-{k % 4}", "width": im.shape[1], "height": im.shape[0], "channels": 1, "data": im.tobytes(), "status": "ok"})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.range(4 * len(f.codes)).mapInArrow(draw, schema.IMAGES)


_ARROW = pa.schema([("image_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary()), ("status", pa.string())])
