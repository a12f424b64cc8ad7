"""Connected components and the boundaries between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def label(t: np.ndarray) -> np.ndarray:
    """Least pixel id of each pixel's component. Equal values connect: across and down, white (255) also by diagonals.

    The first and last column and the pixels of value 127 never start a link; the first row links only to the left.
    """
    h, w = t.shape
    ids = np.arange(h * w, dtype=np.int64).reshape(h, w)
    own = np.zeros((h, w), bool)
    own[:, 1 : w - 1] = t[:, 1 : w - 1] != 127
    pairs = []
    for dy, dx, white in ((0, -1, False), (-1, 0, False), (-1, -1, True), (-1, 1, True)):
        y0 = 1 if dy else 0
        a = ids[y0:, 1 : w - 1]
        b = ids[y0 + dy : h + dy, 1 + dx : w - 1 + dx]
        va, vb = t[y0:, 1 : w - 1], t[y0 + dy : h + dy, 1 + dx : w - 1 + dx]
        ok = own[y0:, 1 : w - 1] & (va == vb)
        if white:
            ok &= va == 255
        pairs.append(np.stack([a[ok], b[ok]]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    root = ids.ravel().copy()
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root.reshape(h, w)
        hi, lo = np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_]
        np.minimum.at(root, hi, lo)
        while True:  # follow labels to their ends
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(ternary: DataFrame) -> DataFrame:
    """(image_id, pixel_id, rep): one task for each image; pixels of value 127 are left out."""

    def run(t: pa.Table) -> pa.Table:
        w, h = t.column("w")[0].as_py(), t.column("h")[0].as_py()
        y, x, v = (t.column(k).to_numpy() for k in ("y", "x", "t"))
        image = np.full((h, w), 127, np.int32)
        image[y, x] = v
        rep = label(image)
        keep = v != 127
        ids = (y.astype(np.int64) * w + x)[keep]
        return pa.table({"image_id": pa.array([t.column("image_id")[0].as_py()] * len(ids), pa.string()), "pixel_id": pa.array(ids), "rep": pa.array(rep.ravel()[ids])})

    return ternary.groupBy("image_id").applyInArrow(run, schema.COMPONENTS)


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("image_id", "rep").agg(F.count(F.lit(1)).alias("size"))


def boundary_points(ternary: DataFrame, found: DataFrame, min_size: int = 25) -> DataFrame:
    """Midpoints between touching black and white components of at least ``min_size`` pixels, in doubled coordinates.

    A point lies to the right, below, below left or below right of a pixel; the one below left is skipped where the pixel to
    the left has just given the same midpoint as its point below right.
    """
    big = component_sizes(found).where(F.col("size") >= min_size).select("image_id", "rep")
    own = ternary.where("t <> 127").withColumn("pixel_id", F.expr("cast(y as bigint) * w + x"))
    own = own.join(found.join(big, ["image_id", "rep"]), ["image_id", "pixel_id"]).select("image_id", "w", "h", "y", "x", "t", "rep")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (-1, 1), (1, 1))])
    start = own.where("x >= 1 and y >= 1 and x <= w - 2 and y <= h - 2").select("image_id", "y", "x", "t", "rep", F.inline(steps))
    start = start.withColumns({"ny": F.col("y") + F.col("dy"), "nx": F.col("x") + F.col("dx")})
    other = own.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("t").alias("t1"), F.col("rep").alias("rep1"))
    hit = start.join(other, ["image_id", "ny", "nx"]).where("t + t1 = 255")
    # what the pixel to the left gave: a (1, 1) point in the column before
    gave = hit.where("dx = 1 and dy = 1").select("image_id", "y", (F.col("x") + 1).alias("x"), F.lit(True).alias("gave"))
    both = hit.join(gave, ["image_id", "y", "x"], "left").where("not (dx = -1 and coalesce(gave, false))")
    return both.select("image_id", F.least("rep", "rep1").alias("lo"), F.greatest("rep", "rep1").alias("hi"), F.expr("2 * x + dx").alias("x"), F.expr("2 * y + dy").alias("y"), F.expr("dx * (t1 - t)").alias("gx"), F.expr("dy * (t1 - t)").alias("gy"))


def clusters(points: DataFrame) -> DataFrame:
    """Size, box and polarity of each pair of components; ``dot`` < 0 is a reversed border."""
    box = points.groupBy("image_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("gx").alias("sgx"), F.sum("gy").alias("sgy"), F.sum(F.expr("x * gx + y * gy")).alias("sxg"))
    cx = F.expr("cast((x0 + x1) * 0.5D + 0.05118D as float)")
    cy = F.expr("cast((y0 + y1) * 0.5D - 0.028581D as float)")
    dot = F.col("sxg") - cx.cast("double") * F.col("sgx") - cy.cast("double") * F.col("sgy")
    return box.select("image_id", "lo", "hi", "n", "x0", "x1", "y0", "y1", F.round(dot, 3).alias("dot"))


def gate(found: DataFrame, w: int, h: int, tag_width: int, min_pixels: int = 5) -> DataFrame:
    """Clusters that may be a border: enough points, not more than a border can have, and a box of some area."""
    return found.where(F.col("n").between(max(24, min_pixels), 2 * (2 * w + 2 * h)) & (F.expr("(x1 - x0) * (y1 - y0)") >= tag_width))


def slopes(points: DataFrame) -> DataFrame:
    """Each point with its place around the cluster's centre: a pseudo-angle that grows with the true one."""
    pair = Window.partitionBy("image_id", "lo", "hi")
    c = points.withColumns({"cx": ((F.min("x").over(pair) + F.max("x").over(pair)) * F.lit(0.5) + 0.05118).cast("float"), "cy": ((F.min("y").over(pair) + F.max("y").over(pair)) * F.lit(0.5) - 0.028581).cast("float")})
    c = c.withColumns({"dx": (F.col("x") - F.col("cx")).cast("float"), "dy": (F.col("y") - F.col("cy")).cast("float")})
    base = F.expr("case when dy > 0 then if(dx > 0, 65536, 131072) else if(dx > 0, 0, -65536) end")
    c = c.withColumns({"base": base, "ex": F.expr("if(dy < 0, -dx, dx)"), "ey": F.expr("if(dy < 0, -dy, dy)")})
    return c.withColumn("slope", (F.col("base") + F.expr("if(ex < 0, -ex / ey, ey / ex)")).cast("float")).drop("cx", "cy", "dx", "dy", "base", "ex", "ey")


def prefix_moments(points: DataFrame) -> DataFrame:
    """Running weighted moments along each cluster's points in order of slope; ``wt`` is a point's weight."""
    run = Window.partitionBy("image_id", "lo", "hi").orderBy("slope", "y", "x", "gx", "gy").rowsBetween(Window.unboundedPreceding, 0)
    fx, fy = F.col("x") * 0.5 + 0.5, F.col("y") * 0.5 + 0.5
    parts = {"mx": fx, "my": fy, "mxx": fx * fx, "mxy": fx * fy, "myy": fy * fy, "w": F.lit(1.0)}
    return points.select("image_id", "lo", "hi", (F.row_number().over(Window.partitionBy("image_id", "lo", "hi").orderBy("slope", "y", "x", "gx", "gy")) - 1).alias("idx"), *[F.sum(e * F.col("wt")).over(run).alias(k) for k, e in parts.items()])


def range_fit(moments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Least-squares line of points i0..i1 (inclusive, around the end if i1 < i0) of each cluster; ranges: image_id, lo, hi, i0, i1.

    Gives the mean point, unit normal, mse (the lesser eigenvalue of the covariance) and err (n times it).
    """
    key, names = ["image_id", "lo", "hi"], ["mx", "my", "mxx", "mxy", "myy", "w"]
    top = moments.groupBy(*key).agg((F.max("idx") + 1).alias("sz"), *[F.max_by(m, "idx").alias(f"t_{m}") for m in names])
    at = moments.select(*key, "idx", *names)
    r = ranges.join(top, key)
    r = r.join(at.select(*key, F.col("idx").alias("i1"), *[F.col(m).alias(f"e_{m}") for m in names]), [*key, "i1"])
    r = r.withColumn("before", F.col("i0") - 1).join(at.select(*key, F.col("idx").alias("before"), *[F.col(m).alias(f"b_{m}") for m in names]), [*key, "before"], "left")
    wrap = F.col("i1") < F.col("i0")
    for m in names:
        r = r.withColumn(m, F.col(f"e_{m}") - F.coalesce(f"b_{m}", F.lit(0.0)) + F.when(wrap, F.col(f"t_{m}")).otherwise(0.0))
    r = r.withColumns({"n": F.expr("i1 - i0 + 1 + if(i1 < i0, sz, 0)"), "ex": F.col("mx") / F.col("w"), "ey": F.col("my") / F.col("w")})
    r = r.withColumns({"cxx": F.expr("mxx / w - ex * ex"), "cxy": F.expr("mxy / w - ex * ey"), "cyy": F.expr("myy / w - ey * ey")})
    r = r.withColumn("root", F.expr("sqrt((cxx - cyy) * (cxx - cyy) + 4 * cxy * cxy)"))
    r = r.withColumns({"mse": F.expr("0.5 * (cxx + cyy - root)"), "big": F.expr("0.5 * (cxx + cyy + root)")})
    r = r.withColumns({"ax": F.expr("cxx - big"), "bx": F.expr("cyy - big")})
    first = F.expr("ax * ax + cxy * cxy > bx * bx + cxy * cxy")
    r = r.withColumns({"nx": F.when(first, F.col("ax")).otherwise(F.col("cxy")), "ny": F.when(first, F.col("cxy")).otherwise(F.col("bx"))})
    length = F.sqrt(F.expr("nx * nx + ny * ny"))
    r = r.withColumn("len", length)
    unit = [F.when(F.col("len") < 1e-12, 0.0).otherwise(F.col(k) / F.col("len")).alias(k) for k in ("nx", "ny")]
    return r.select(*key, "i0", "i1", "n", "ex", "ey", *unit, "mse", (F.col("n") * F.col("mse")).alias("err"))
