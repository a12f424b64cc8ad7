"""Sums of large count vectors over all partitions, without one task or the driver holding more than a bounded number of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of one block of a vector, and parts into which the rows of a block are first summed.
BLOCK, SALTS = 16_384, 32
_ROWS = "block int, salt int, data binary"


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in table.column("data").to_pylist():
        total += np.frombuffer(x, np.int64)
    return pa.table({"block": table.column("block").slice(0, 1), "salt": table.column("salt").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def sum_vectors(docs: DataFrame, count: Callable, size: int) -> np.ndarray:
    """``count(batches, total)`` adds what a partition holds to an int64 vector; the sum over all partitions.

    What reaches the driver is one vector of ``size`` entries.
    """

    def run(batches):
        total = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
        count(batches, total)
        parts = total.reshape(-1, BLOCK)
        some = np.flatnonzero(parts.any(axis=1))
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), salt, np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["block", "salt", "data"])

    once = docs.mapInArrow(run, _ROWS).groupBy("block", "salt").applyInArrow(_sum, _ROWS)
    whole = once.groupBy("block").applyInArrow(_sum, _ROWS)
    out = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
    for r in whole.select("block", "data").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(bytes(r.data), np.int64)
    return out[:size]


#: Ids that may be broadcast (under 40 bytes each); beyond, the tables are joined by a shuffle.
LABELLED = 2_000_000


def with_labels(docs: DataFrame, labels: DataFrame, column: str, how: str = "left") -> DataFrame:
    """``docs`` with _label: the greatest ``column`` of each doc_id in ``labels``, null where there is none."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max(F.col(column).cast("int")).alias("_label"))
    side = F.broadcast(rows) if rows.count() <= LABELLED else rows
    return docs.join(side, F.col("doc_id").cast("bigint") == F.col("_id"), how).drop("_id")
