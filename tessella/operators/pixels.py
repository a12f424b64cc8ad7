"""Dense stages on pixel tables (image_id, w, h, y, x, v): resampling, filtering, tiles and thresholds.

All are groupings or row windows keyed by the image, so images spread over the cluster and none is gathered whole.
Neighbourhoods of tiles go by explode and groupBy (combined before the shuffle), neighbourhoods of pixels by two window passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["image_id", "w", "h"]
TILE = 4


def _int(e: str) -> Column:
    return F.expr(f"cast({e} as int)")


def from_matrix(rows: DataFrame, row: str, values: str, image_id: str = "matrix") -> DataFrame:
    """A table with one array for each row as a gray image: v = clamp(floor((e + 0.55) * 230), 0, 255)."""
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 0.55) * 230))).cast("int")
    h = rows.agg((F.max(row) + 1).cast("int")).scalar()
    pixels = rows.select(F.col(row).cast("int").alias("y"), F.size(values).alias("w"), F.posexplode(values).alias("x", "e"))
    return pixels.select(F.lit(image_id).alias("image_id"), "w", h.alias("h"), "y", "x", v.alias("v"))


def unpack(images: DataFrame) -> DataFrame:
    """Packed gray images as pixels; the bytes are read from their hexadecimal form, so nothing leaves the JVM."""
    pos = images.select("image_id", F.col("width").alias("w"), F.col("height").alias("h"), F.posexplode(F.split(F.regexp_replace(F.hex("data"), "(..)", "$1 "), " ")).alias("i", "b")).where("b <> ''")
    return pos.select("image_id", "w", "h", _int("i div w").alias("y"), _int("i % w").alias("x"), F.conv("b", 16, 10).cast("int").alias("v"))


def pack(pixels: DataFrame) -> DataFrame:
    """Pixels as packed gray images."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    data = F.unhex(F.array_join(F.transform("r", lambda p: F.lpad(F.hex(p["v"]), 2, "0")), ""))
    return pixels.groupBy(*KEY).agg(rows.alias("r")).select("image_id", F.col("w").alias("width"), F.col("h").alias("height"), F.lit(1).alias("channels"), data.alias("data"), F.lit("ok").alias("status"))


def synthetic(spark, kind: str, w: int, h: int, value: int = 0, image_id: str | None = None) -> DataFrame:
    """A generated image: ``zero``, ``constant`` (value), ``identity`` (1 on the diagonal) or ``random`` (a hash of seed and place)."""
    p = spark.range(w * h).select(F.lit(image_id or kind).alias("image_id"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.expr(f"cast(id div {w} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))
    made = {"zero": F.lit(0), "constant": F.lit(value), "identity": F.when(F.col("x") == F.col("y"), 1).otherwise(0), "random": F.expr(f"cast(pmod((x * 7919L + y * 104729L + {value}L * 1299709L) * 48271L, 2147483647L) % 256 as int)")}
    if kind not in made:
        raise ValueError(f"unknown kind {kind}")
    return p.withColumn("v", made[kind])


def decimate(pixels: DataFrame, factor: float) -> DataFrame:
    """Every factor-th pixel, or for 1.5 each 3 x 3 block blended into 2 x 2."""
    if factor == 1.5:
        block = pixels.where(F.expr("x < w div 3 * 3 and y < h div 3 * 3")).withColumns({"bx": _int("x div 3"), "by": _int("y div 3"), "k": F.expr("y % 3 * 3 + x % 3")})
        at = [F.sum(F.when(F.col("k") == k, F.col("v"))).alias(f"p{k}") for k in range(9)]
        block = block.groupBy(*KEY, "by", "bx").agg(*at)
        corner = {(0, 0): (0, 1, 3), (1, 0): (2, 1, 5), (0, 1): (6, 3, 7), (1, 1): (8, 5, 7)}  # a corner and its two edges
        out = [F.struct(F.expr(f"cast(by * 2 + {dy} as int)").alias("y"), F.expr(f"cast(bx * 2 + {dx} as int)").alias("x"), _int(f"(4 * p{c} + 2 * p{a} + 2 * p{b} + p4) div 9").alias("v")) for (dx, dy), (c, a, b) in corner.items()]
        return block.select("image_id", _int("w div 3 * 2").alias("w"), _int("h div 3 * 2").alias("h"), F.inline(F.array(*out)))
    f = int(factor)
    if f != factor or f < 1:
        raise ValueError("the factor must be 1.5 or a whole number")
    kept = pixels.where(f"x % {f} = 0 and y % {f} = 0")
    return kept.select("image_id", _int(f"1 + (w - 1) div {f}").alias("w"), _int(f"1 + (h - 1) div {f}").alias("h"), _int(f"y div {f}").alias("y"), _int(f"x div {f}").alias("x"), "v")


def gaussian_kernel(sigma: float, size: int) -> list[int]:
    """Integer weights of at most 255 in all, cut towards zero."""
    raw = [math.exp(-0.5 * ((i - size // 2) / sigma) ** 2) for i in range(size)]
    return [int(x / sum(raw) * 255) for x in raw]


def _convolve(pixels: DataFrame, kernel: list[int], along: str, across: str, size: str) -> DataFrame:
    k = len(kernel)
    w = Window.partitionBy("image_id", across).orderBy(along)
    total = sum((F.lag("v", k // 2 - j).over(w) if j < k // 2 else F.lead("v", j - k // 2).over(w)) * c for j, c in enumerate(kernel))
    inside = (F.col(along) >= k // 2) & (F.col(along) < F.col(size) - k + k // 2)
    return pixels.withColumn("v", F.when(inside, F.shiftright(total.cast("int"), 8)).otherwise(F.col("v")))


def convolve(pixels: DataFrame, kernel: list[int]) -> DataFrame:
    """Separable integer convolution, rows then columns; the edges, and the last full window of a line, are copied."""
    return _convolve(_convolve(pixels, kernel, "x", "y", "w"), kernel, "y", "x", "h")


def kernel_size(sigma: float) -> int:
    k = int(4 * abs(sigma))
    return k + 1 if k % 2 == 0 else k


def gaussian_blur(pixels: DataFrame, sigma: float, size: int | None = None) -> DataFrame:
    k = size or kernel_size(sigma)
    return convolve(pixels, gaussian_kernel(abs(sigma), k)) if sigma and k > 1 else pixels


def unsharp(pixels: DataFrame, sigma: float) -> DataFrame:
    """clamp(2 * v - blurred)."""
    soft = gaussian_blur(pixels.withColumn("o", F.col("v")), sigma)
    return soft.withColumn("v", F.greatest(F.lit(0), F.least(F.lit(255), 2 * F.col("o") - F.col("v")))).drop("o")


def darken(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", _int("v div 2"))


def rotate(pixels: DataFrame, radians: float, pad: int) -> DataFrame:
    """Turn images about their centre into their new bounding box (nearest pixel, ``pad`` outside)."""
    c, s = math.cos(radians), math.sin(radians)
    dims = pixels.select(*KEY).distinct()
    ow = F.ceil(F.abs(F.col("w") * c) + F.abs(F.col("h") * s)).cast("int")
    oh = F.ceil(F.abs(F.col("w") * s) + F.abs(F.col("h") * c)).cast("int")
    spark = pixels.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = dims.withColumns({"ow": ow, "oh": oh}).withColumn("oy", F.explode(F.sequence(F.lit(0), F.col("oh") - 1))).repartition(parts, "image_id", "oy")
    grid = lines.withColumn("ox", F.explode(F.sequence(F.lit(0), F.col("ow") - 1)))
    dx, dy = F.col("ox") + 0.5 - F.col("ow") / 2, F.col("oy") + 0.5 - F.col("oh") / 2
    grid = grid.withColumns({"sx": F.floor(dx * c + dy * s + F.col("w") / 2).cast("int"), "sy": F.floor(-dx * s + dy * c + F.col("h") / 2).cast("int")})
    inside = F.expr("sx between 0 and w - 1 and sy between 0 and h - 1")
    # a long narrow image has far more padding than pixels, so only places on the image are joined
    found = grid.where(inside).join(pixels.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "v"), ["image_id", "sx", "sy"], "left")
    turned = [F.col(a).alias(b) for a, b in (("image_id", "image_id"), ("ow", "w"), ("oh", "h"), ("oy", "y"), ("ox", "x"))]
    return found.select(*turned, F.coalesce("v", F.lit(pad)).alias("v")).unionByName(grid.where(~inside).select(*turned, F.lit(pad).alias("v")))


def tile_minmax(pixels: DataFrame) -> DataFrame:
    """Least and greatest value of each full tile."""
    full = pixels.where(f"x < w div {TILE} * {TILE} and y < h div {TILE} * {TILE}")
    return full.groupBy(*KEY, _int(f"y div {TILE}").alias("ty"), _int(f"x div {TILE}").alias("tx")).agg(F.min("v").alias("mn"), F.max("v").alias("mx"))


def neighbour_minmax(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """The same over each tile and its eight neighbours, as far as they exist."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    near = tiles.select(*KEY, "ty", "tx", "mn", "mx", F.inline(steps)).select(*KEY, (F.col("ty") + F.col("dy")).alias("ty"), (F.col("tx") + F.col("dx")).alias("tx"), "mn", "mx")
    near = near.where(f"tx >= 0 and ty >= 0 and tx < w div {tile} and ty < h div {tile}")
    return near.groupBy(*KEY, "ty", "tx").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def threshold(pixels: DataFrame, min_diff: int = 5, contrast_in_partial_tiles: bool = False) -> DataFrame:
    """t: 127 where the tiles around have little contrast, else 255 above their middle value and 0 at or under it.

    Pixels beyond the last full tile use the nearest one, without the contrast test unless asked for.
    """
    tiles = neighbour_minmax(tile_minmax(pixels)).select("image_id", "ty", "tx", "mn", "mx")
    own = pixels.withColumns({"ty": _int(f"least(y div {TILE}, h div {TILE} - 1)"), "tx": _int(f"least(x div {TILE}, w div {TILE} - 1)")})
    flat = F.col("mx") - F.col("mn") < min_diff
    if not contrast_in_partial_tiles:
        flat = flat & F.expr(f"x < w div {TILE} * {TILE} and y < h div {TILE} * {TILE}")
    t = F.when(flat, 127).when(F.expr("v > mn + (mx - mn) div 2"), 255).otherwise(0)
    return own.join(tiles, ["image_id", "ty", "tx"]).select(*KEY, "y", "x", t.alias("t"))


def _around(rows: DataFrame, value: str, pick) -> DataFrame:
    across = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-1, 1)
    down = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-1, 1)
    return rows.withColumn("_a", pick(value).over(across)).withColumn("_b", pick("_a").over(down)).drop("_a")


def deglitch(ternary: DataFrame) -> DataFrame:
    """3 x 3 maximum, then minimum, inside the image; the outermost pixels count as 0 between the two and stay as they were."""
    inside = F.expr("x > 0 and y > 0 and x < w - 1 and y < h - 1")
    wide = _around(ternary, "t", F.max).withColumn("d", F.when(inside, F.col("_b")).otherwise(0)).drop("_b")
    return _around(wide, "d", F.min).withColumn("t", F.when(inside, F.col("_b")).otherwise(F.col("t"))).drop("_b", "d")


def bayer_threshold(pixels: DataFrame, tile: int = 32, raw: bool = False) -> DataFrame:
    """Threshold of a colour-filter mosaic: each of the four phases by its own extremes in 3 x 3 tiles of 32 x 32; 0 or 255 (raw: 1)."""
    own = pixels.withColumns({"ty": _int(f"y div {tile}"), "tx": _int(f"x div {tile}"), "phase": _int("2 * (y % 2) + x % 2")})
    tiles = own.groupBy("image_id", "phase", "ty", "tx").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    near = tiles.select("image_id", "phase", "ty", "tx", "mn", "mx", F.inline(steps)).groupBy("image_id", "phase", (F.col("ty") + F.col("dy")).alias("ty"), (F.col("tx") + F.col("dx")).alias("tx")).agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    t = F.when(F.expr("v > mn + (mx - mn) div 2"), 1 if raw else 255).otherwise(0)
    return own.join(near, ["image_id", "phase", "ty", "tx"]).select(*KEY, "y", "x", t.alias("t"))


def sharpen(values: DataFrame, amount: float) -> DataFrame:
    """v + amount * (4 v - the four neighbours), neighbours outside counting as 0; rows (key..., y, x, v) with a ``quad`` key."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(k).alias("k")) for dy, dx, k in ((0, 0, 4.0), (-1, 0, -1.0), (1, 0, -1.0), (0, -1, -1.0), (0, 1, -1.0))])
    spread = values.select("quad", "y", "x", "v", F.inline(steps)).groupBy("quad", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).agg(F.sum(F.col("v") * F.col("k")).alias("lap"))
    return values.join(spread, ["quad", "y", "x"]).select("quad", "y", "x", (F.col("v") + amount * F.col("lap")).alias("v"))


def sample(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Bilinear value at points (image_id, point_id, px, py), taking pixel centres at +0.5; points off the image drop out."""
    p = points.withColumns({"qx": F.col("px") - 0.5, "qy": F.col("py") - 0.5})
    p = p.withColumns({"x1": F.floor("qx"), "y1": F.floor("qy"), "x2": F.ceil("qx"), "y2": F.ceil("qy")})
    fx, fy = F.col("qx") - F.col("x1"), F.col("qy") - F.col("y1")
    corner = [F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"), (wx * wy).alias("weight")) for x, wx in (("x1", 1 - fx), ("x2", fx)) for y, wy in (("y1", 1 - fy), ("y2", fy))]
    four = p.select("image_id", "point_id", F.inline(F.array(*corner)))
    hit = four.join(pixels.select("image_id", "x", "y", "v"), ["image_id", "x", "y"])
    return hit.groupBy("image_id", "point_id").agg(F.sum(F.col("v") * F.col("weight")).alias("v"), F.count(F.lit(1)).alias("n")).where("n = 4").drop("n")
