"""Circular sequences: smoothing, strict local maxima and top-k with ties."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def taps(sigma: float = 1.0, cutoff: float = 0.05) -> list[float]:
    """Gaussian weights out to where they fall under the cutoff, centre 1, not normalised."""
    reach = int(math.sqrt(-2 * math.log(cutoff)) * sigma + 1)
    return [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]


def smooth(rows: DataFrame, key: list[str], value: str, weights: list[float] | None = None) -> DataFrame:
    """Adds ``smooth``: the circular weighted sum around each row; rows have idx 0..n-1 within the key."""
    weights = weights or taps()
    half = len(weights) // 2
    seq = rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", value))), lambda s: s[value].cast("double")).alias("_s"))
    n = F.size("_s")
    total = F.transform("_s", lambda _, i: sum(F.element_at("_s", (F.pmod(i + (k - half), n) + 1).cast("int")) * wt for k, wt in enumerate(weights)))
    return seq.select(*key, F.col("_s").alias("raw"), total.alias("s")).select(*key, F.posexplode(F.arrays_zip("raw", "s")).alias("idx", "z")).select(*key, "idx", F.col("z.raw").alias(value), F.col("z.s").alias("smooth"))


def local_maxima(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows strictly above both neighbours, the first and the last being neighbours too."""
    w = Window.partitionBy(*key).orderBy("idx")
    ends = Window.partitionBy(*key)
    before = F.coalesce(F.lag(value).over(w), F.max_by(value, "idx").over(ends))
    after = F.coalesce(F.lead(value).over(w), F.min_by(value, "idx").over(ends))
    return rows.withColumns({"_b": before, "_a": after}).where((F.col(value) > F.col("_b")) & (F.col(value) > F.col("_a"))).drop("_b", "_a")


def top_k(rows: DataFrame, key: list[str], value: str, k: int) -> DataFrame:
    """Rows above the (k+1)-th largest value of their key: k of them, fewer on ties; all where there are at most k."""
    place = Window.partitionBy(*key).orderBy(F.desc(value))
    limit = F.max(F.when(F.col("_r") == k + 1, F.col(value))).over(Window.partitionBy(*key))
    ranked = rows.withColumn("_r", F.row_number().over(place)).withColumn("_l", limit)
    return ranked.where(F.col("_l").isNull() | (F.col(value) > F.col("_l"))).drop("_r", "_l")
