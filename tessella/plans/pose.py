"""Poses of detections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import schema
from ..functions.pose import estimate


def poses(detections: DataFrame, tag_size: float, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Rotation (row by row), translation and object-space error of each detection, for a camera and a marker of ``tag_size``."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rot, t, err = estimate(np.array(r["h"]).reshape(3, 3), tag_size, fx, fy, cx, cy)
                rows.append({"image_id": r["image_id"], "family": r["family"], "id": r["id"], "r": rot.ravel().tolist(), "t": t.tolist(), "err": float(err)})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return detections.select("image_id", "family", "id", "h").mapInArrow(run, schema.POSES)


_ARROW = pa.schema([("image_id", pa.string()), ("family", pa.string()), ("id", pa.int32()), ("r", pa.list_(pa.float64())), ("t", pa.list_(pa.float64())), ("err", pa.float64())])
