"""Shapes as pixels: lines, discs and rings, and lines drawn by a table of values over the distance from them.

Shapes are rows; each is exploded to the pixels it covers. Drawing into an image is a join on the pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _inside(w: int, h: int) -> Column:
    return F.expr(f"x BETWEEN 0 AND {w - 1} AND y BETWEEN 0 AND {h - 1}")


def line_pixels(lines: DataFrame, key: list[str], w: int, h: int) -> DataFrame:
    """(key, y, x): the pixels of lines x0, y0, x1, y1, stepped by half a pixel from the end to the start; a line without length has none."""
    steps = lines.withColumn("_d", F.sqrt(F.expr("(x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)"))).where("_d > 0")
    at = steps.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(2 * F.col("_d")).cast("int"))))
    x, y = (F.expr(f"cast({c}1 + ({c}0 - {c}1) * (_k * 0.5D / _d) as int)").alias(c) for c in "xy")
    return at.select(*key, y, x).where(_inside(w, h)).distinct()


def ring_pixels(rings: DataFrame, key: list[str], w: int, h: int) -> DataFrame:
    """(key, y, x): the pixels whose distance from x0, y0 is from r0 to r1; a disc has r0 = 0."""
    rows = rings.withColumn("y", F.explode(F.sequence(F.floor(F.expr("y0 - r1")).cast("int"), F.ceil(F.expr("y0 + r1")).cast("int"))))
    rows = rows.withColumn("x", F.explode(F.sequence(F.floor(F.expr("x0 - r1")).cast("int"), F.ceil(F.expr("x0 + r1")).cast("int"))))
    d = F.expr("(x - x0) * (x - x0) + (y - y0) * (y - y0)")
    return rows.where((d >= F.expr("r0 * r0")) & (d <= F.expr("r1 * r1")) & _inside(w, h)).select(*key, "y", "x")


def line_values(lines: DataFrame, key: list[str], values: list[int], scale: float, w: int, h: int) -> DataFrame:
    """(key, y, x, v): values[floor(d * scale)] for pixels whose centre has the squared distance d from the line."""
    reach = ((len(values) - 1) / scale) ** 0.5
    rows = lines.withColumns({"_len": F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"), "_r": F.lit(reach)}).where("_len > 0")
    for c, n in (("y", h), ("x", w)):
        span = F.sequence(F.expr(f"cast(greatest(0, least({n - 1}, least({c}0, {c}1) - _r)) as int)"), F.expr(f"cast(greatest(0, least({n - 1}, greatest({c}0, {c}1) + _r)) as int)"))
        rows = rows.withColumn(c, F.explode(span))
    along = F.expr("greatest(0D, least(_len, ((x + 0.5D - x0) * (x1 - x0) + (y + 0.5D - y0) * (y1 - y0)) / _len))")
    rows = rows.withColumn("_t", along)
    d = F.expr("pow(x + 0.5D - x0 - _t * (x1 - x0) / _len, 2) + pow(y + 0.5D - y0 - _t * (y1 - y0) / _len, 2)")
    rows = rows.withColumn("_i", F.floor(d * scale).cast("int")).where(F.col("_i") < len(values))
    return rows.select(*key, "y", "x", F.get(F.array(*map(F.lit, values)), F.col("_i")).alias("v"))


def draw(pixels: DataFrame, shape: DataFrame, value: Column, brighter: bool = False) -> DataFrame:
    """``pixels`` (image_id, w, h, y, x, v) with ``value`` at the pixels of ``shape`` (image_id, y, x); with ``brighter`` only where it is larger."""
    marks = shape.withColumn("_v", value).groupBy("image_id", "y", "x").agg(F.max("_v").alias("_v"))
    v = F.greatest("v", "_v") if brighter else F.coalesce("_v", "v")
    return pixels.join(marks, ["image_id", "y", "x"], "left").select("image_id", "w", "h", "y", "x", v.alias("v"))
