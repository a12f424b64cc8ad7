"""Detections that no overlapping one beats."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.functions import geometry
from tessella.operators import compare

SCHEMA = "k int, image string, p array<struct<x:double,y:double>>, hamming int, margin double"


def _made(n: int, spread: float, seed: int):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        at, size = rng.integers(-spread, spread, 2).tolist(), float(rng.integers(1, 8))
        corners = [(0, 0), (1, 0), (1, 1), (0, 1)][: 3 + int(rng.integers(2))]
        rows.append((k, [None, "a", "b"][rng.integers(3)], [(at[0] + size * x, at[1] + size * y) for x, y in corners], int(rng.integers(3)), float(rng.integers(6)) / 2))
    return rows


def test_unbeaten_is_every_pair_compared(spark):
    """Triangles and squares, many alike, touching and of equal rank; also places under zero and detections without an image."""
    for spread in (5, 60):
        rows = _made(220, spread, spread) + [(999, "c", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)], 0, 1.0)]
        want = set()
        for a in rows:
            better = [b for b in rows if b[1] == a[1] and (b[3], -b[4]) < (a[3], -a[4])]
            if not any(geometry.polygons_overlap(np.array(a[2]), np.array(b[2])) for b in better):
                want.add(a[0])
        left = compare.unbeaten(spark.createDataFrame(rows, SCHEMA), "image", "p", F.struct("hamming", (-F.col("margin")).alias("m")))
        assert left.columns == ["k", "image", "p", "hamming", "margin"]
        assert sorted(r.k for r in left.collect()) == sorted(want)
    assert compare.unbeaten(spark.createDataFrame([], SCHEMA), "image", "p", F.struct("hamming", "margin")).count() == 0


def test_a_crowd_is_not_compared_in_pairs(monkeypatch):
    rng, n, asked = np.random.default_rng(3), 2000, []
    at = rng.random((n, 2)) * 20
    polygons = [[{"x": x + dx, "y": y + dy} for dx, dy in ((0, 0), (9, 0), (9, 9), (0, 9))] for x, y in at.tolist()]
    rank = [{"r": int(r)} for r in rng.permutation(n)]
    plain = geometry.overlaps_many
    monkeypatch.setattr(compare.geometry, "overlaps_many", lambda p, q: (asked.append(len(p)), plain(p, q))[1])
    found, _ = compare._least_overlapping(pa.table({"polygon": polygons, "best": rank, "worst": rank}))
    assert len(found) > 0.9 * n
    assert sum(asked) < 5 * n
