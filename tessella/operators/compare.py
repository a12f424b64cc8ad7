"""Comparing runs, detections that overlap, and timing statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import geometry

# What two runs may differ by.
CENTRE, CORNER, MARGIN = 0.25, 0.5, 0.05
#: By so much boxes of polygons are taken larger, so that rounding loses no touch.
MARGIN_OF_BOXES = 1e-6


def pair_by_id(a: DataFrame, b: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Full outer join of two runs by key and position within it; status says which side lacks a row."""
    w = Window.partitionBy(key).orderBy(*order)
    left = a.select(F.col(key), F.row_number().over(w).alias("pos"), *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    right = b.select(F.col(key), F.row_number().over(w).alias("pos"), *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("both")
    return left.join(right, [key, "pos"], "full_outer").withColumn("status", status).drop("_a", "_b")


def report_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Detections (image_id, id, hamming, decision_margin, cx, cy, corners) of two runs, paired, with what differs by more than allowed."""
    w = Window.partitionBy("image_id", "id").orderBy("cx", "cy")
    cols = ["hamming", "decision_margin", "cx", "cy", "corners"]
    left = a.select("image_id", "id", F.row_number().over(w).alias("pos"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select("image_id", "id", F.row_number().over(w).alias("pos"), *[F.col(c).alias(f"b_{c}") for c in cols])
    far = F.array_max(F.zip_with("a_corners", "b_corners", lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))
    paired = left.join(right, ["image_id", "id", "pos"], "full_outer").withColumns({"centre": F.hypot(F.col("a_cx") - F.col("b_cx"), F.col("a_cy") - F.col("b_cy")), "corner": far, "margin": F.abs(F.col("a_decision_margin") - F.col("b_decision_margin"))})
    status = F.when(F.col("b_hamming").isNull(), "missing").when(F.col("a_hamming").isNull(), "extra").when((F.col("a_hamming") != F.col("b_hamming")) | (F.col("centre") > CENTRE) | (F.col("corner") > CORNER) | (F.col("margin") > MARGIN), "differs").otherwise("same")
    return paired.select("image_id", "id", "pos", "centre", "corner", "margin", status.alias("status"))


def stats(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mean and population deviation."""
    return rows.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def stage_deltas(stamps: DataFrame, run: str, seq: list[str], utime: str) -> DataFrame:
    """Time since the stage before and since the first one, for each stamp of a run."""
    w = Window.partitionBy(run).orderBy(*seq)
    return stamps.withColumns({"delta": F.col(utime) - F.lag(utime).over(w), "total": F.col(utime) - F.first(utime).over(w)})


def total_time(stamps: DataFrame, run: str, utime: str) -> DataFrame:
    return stamps.groupBy(run).agg((F.max(utime) - F.min(utime)).alias("total"))


def high_water(events: DataFrame, run: str, seq: list[str], size: str) -> DataFrame:
    """Greatest running sum of allocations (negative: freed) of each run."""
    w = Window.partitionBy(run).orderBy(*seq).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_s", F.sum(size).over(w)).groupBy(run).agg(F.max("_s").alias("peak"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, duplicates counted: side is 'a' or 'b'."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def _corners(polygons: pa.Array) -> np.ndarray:
    """polygons x corners x 2; one with fewer corners repeats its last."""
    n = pc.list_value_length(polygons).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(polygons)
    xy = np.stack([pc.struct_field(flat, name).to_numpy(zero_copy_only=False) for name in ("x", "y")], axis=1)
    return xy[(np.cumsum(n) - n)[:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)]


def _least_overlapping(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows (polygon, best, worst), and of the row of least ``best`` that each overlaps, where that is less than its ``worst``."""
    ranks = np.concatenate([np.stack([x.to_numpy(zero_copy_only=False).astype(float) + 0.0 for x in t.column(c).combine_chunks().flatten()], axis=1) for c in ("best", "worst")])
    place = np.unique(ranks, axis=0, return_inverse=True)[1].reshape(2, -1)
    best, worst = place
    p = _corners(t.column("polygon").combine_chunks())
    low, high = p.min(axis=1) - MARGIN_OF_BOXES, p.max(axis=1) + MARGIN_OF_BOXES
    found, by, live = [], [], np.arange(len(p))
    for q in np.argsort(best, kind="stable").tolist():
        live = live[worst[live] > best[q]]
        if not len(live):
            break
        near = np.flatnonzero((low[live] <= high[q]).all(axis=1) & (high[live] >= low[q]).all(axis=1))
        hit = near[geometry.overlaps_many(p[live[near]], p[q])]
        found.append(live[hit])
        by.append(np.full(len(hit), q))
        live = np.delete(live, hit)
    return (np.concatenate(found), np.concatenate(by)) if found else (np.zeros(0, int), np.zeros(0, int))


def unbeaten(rows: DataFrame, key: str, polygon: str, rank: Column) -> DataFrame:
    """The rows whose polygon overlaps none of the same ``key`` with a lesser rank (a struct of numbers).

    Equal polygons are one, with its least rank. Each goes to the cells that its box touches, which are as wide as the widest box of the key; in a cell
    polygons are asked in order of rank, and one that an asked polygon overlaps is asked about no more, so a crowd costs hardly more than its rows.
    """
    own = rows.withColumn("_rank", rank)
    some = own.where(F.size(polygon) > 2).groupBy(F.col(key).alias("key"), F.col(polygon).alias("polygon")).agg(F.min("_rank").alias("best"), F.max("_rank").alias("worst"))
    end = {f"{name}_{c}": f(f"polygon.{c}") for c in "xy" for name, f in (("least", F.array_min), ("most", F.array_max))}
    boxes = some.withColumns(end)
    side = boxes.groupBy("key").agg(F.max(F.greatest(F.col("most_x") - F.col("least_x"), F.col("most_y") - F.col("least_y"))).alias("extent")).select(F.col("key").alias("_k"), (F.col("extent") + 4 * MARGIN_OF_BOXES).alias("side"))
    cells = boxes.join(side, F.col("key").eqNullSafe(F.col("_k")))
    for c in "xy":
        first, last = (F.floor((F.col(f"{name}_{c}") + d) / F.col("side")) for name, d in (("least", -MARGIN_OF_BOXES), ("most", MARGIN_OF_BOXES)))
        cells = cells.withColumn(f"cell_{c}", F.explode(F.sequence(first, last)))

    def sweep(t: pa.Table) -> pa.Table:
        at, by = _least_overlapping(t)
        return pa.table({"key": t.column("key").take(pa.array(at)), "polygon": t.column("polygon").take(pa.array(at)), "by": t.column("best").take(pa.array(by))})

    schema = StructType([StructField(name, some.schema[c].dataType) for name, c in (("key", "key"), ("polygon", "polygon"), ("by", "best"))])
    cells = cells.select("key", "polygon", "best", "worst", "cell_x", "cell_y").groupBy("key", "cell_x", "cell_y")
    by = cells.applyInArrow(sweep, schema).groupBy("key", "polygon").agg(F.min("by").alias("_by"))
    by = by.select(F.col("key").alias("_key"), F.col("polygon").alias("_polygon"), "_by")
    joined = own.join(by, F.col(key).eqNullSafe(F.col("_key")) & (F.col(polygon) == F.col("_polygon")), "left")
    return joined.where(F.col("_by").isNull() | (F.col("_by") >= F.col("_rank"))).select(*rows.columns)
