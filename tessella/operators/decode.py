"""From code words and samples to identities, as joins and aggregates."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import families as fam


def render(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    """Every marker of the families as pixels (family, id, y, x, v): the white ring, and the bits of the code."""
    kinds = {n: fam.family(n) for n in names}
    base = []
    for n, f in kinds.items():
        ring = f.width_at_border + (0 if f.reversed_border else 2)
        at = (f.total_width - ring) // 2
        last = at + ring - 1
        place = {(x + (f.total_width - f.width_at_border) // 2, y + (f.total_width - f.width_at_border) // 2): i for i, (x, y) in enumerate(f.bits)}
        for y in range(f.total_width):
            for x in range(f.total_width):
                white = (x in (at, last) and at <= y <= last) or (y in (at, last) and at <= x <= last)
                base.append((n, f.nbits, y, x, place.get((x, y)), int(white)))
    cells = spark.createDataFrame(base, "family string, nbits int, y int, x int, bit int, white int")
    bit = F.when(F.col("bit").isNotNull(), F.call_function("shiftright", "code", F.expr("nbits - 1 - bit")).bitwiseAND(F.lit(1))).otherwise(0)
    # both sides are fixed tables of the family
    return fam.family_codes(spark, names).join(F.broadcast(cells), "family").select("family", "id", "y", "x", F.when((F.col("white") == 1) | (bit == 1), 255).otherwise(0).alias("v"))


def rotate90(code: Column, nbits: int) -> Column:
    """The code word of a marker turned by a quarter; an odd layout keeps its centre bit."""
    odd = nbits % 4
    p = nbits - odd
    w = F.shiftright(code, odd)
    turned = F.shiftleft(w, p // 4).bitwiseOR(F.shiftright(w, 3 * p // 4)).bitwiseAND(F.lit((1 << p) - 1).cast("bigint"))
    return F.shiftleft(turned, 1).bitwiseOR(code.bitwiseAND(F.lit(1).cast("bigint"))) if odd else turned


#: Correctable words that may be broadcast (16 bytes each); beyond, the words are joined by a shuffle.
BROADCAST_WORDS = 1_000_000


def correctable(spark: SparkSession, name: str, max_hamming: int) -> DataFrame:
    """(word, id, hamming) of every word within ``max_hamming`` wrong bits of a code word, with the least such id: a fixed table of the family."""
    f = fam.family(name)
    masks = [sum(1 << b for b in bits) for k in range(max_hamming + 1) for bits in combinations(range(f.nbits), k)]
    codes, masks = np.array(f.codes, np.int64), np.array(masks, np.int64)
    words, first = np.unique((codes[:, None] ^ masks[None, :]).ravel(), return_index=True)
    ids = (first // len(masks)).astype(np.int32)
    wrong = np.bitwise_count(masks)[first % len(masks)].astype(np.int32)
    return spark.createDataFrame(pa.table({"word": words, "id": ids, "hamming": wrong}))


def lookup(words: DataFrame, name: str, max_hamming: int = 2) -> DataFrame:
    """Identity of each row with ``rcode``: the first rotation, then the least id, within ``max_hamming`` wrong bits.

    Adds id, hamming and rotation; rows without one drop out, equal rows stay. Each rotation is looked up by a hash join with
    the family's correctable words.
    """
    if max_hamming > 3:
        raise ValueError("at most 3 wrong bits can be corrected")
    f = fam.family(name)
    known = correctable(words.sparkSession, name, max_hamming)
    each = sum(math.comb(f.nbits, k) for k in range(max_hamming + 1))
    names, rows, turned, found = words.columns, words, F.col("rcode"), []
    for r in range(4):
        side = known.select(F.col("word").alias(f"_word{r}"), F.struct("id", "hamming", F.lit(r).alias("rotation")).alias(f"_found{r}"))
        side = F.broadcast(side) if len(f.codes) * each <= BROADCAST_WORDS else side
        rows = rows.join(side, turned == F.col(f"_word{r}"), "left")
        turned, found = rotate90(turned, f.nbits), [*found, F.col(f"_found{r}")]
    return rows.select(*names, F.coalesce(*found).alias("_b")).where("_b is not null").select(*names, "_b.id", "_b.hamming", "_b.rotation")


def gray_model(samples: DataFrame, key: list[str]) -> DataFrame:
    """Least-squares plane c0 * x + c1 * y + c2 through samples (key, x, y, v): nine sums, then Cramer's rule."""
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    sums = samples.groupBy(*key).agg(F.sum(x * x).alias("a"), F.sum(x * y).alias("b"), F.sum(x).alias("c"), F.sum(y * y).alias("d"), F.sum(y).alias("e"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(x * v).alias("p"), F.sum(y * v).alias("q"), F.sum(v).cast("double").alias("r"))
    det = "(a * (d * n - e * e) - b * (b * n - e * c) + c * (b * e - d * c))"
    c0 = f"(p * (d * n - e * e) - b * (q * n - e * r) + c * (q * e - d * r)) / nullif({det}, 0)"
    c1 = f"(a * (q * n - e * r) - p * (b * n - e * c) + c * (b * r - q * c)) / nullif({det}, 0)"
    c2 = f"(a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / nullif({det}, 0)"
    return sums.select(*key, F.expr(c0).alias("c0"), F.expr(c1).alias("c1"), F.expr(c2).alias("c2"))


def margin(values: DataFrame, key: list[str]) -> DataFrame:
    """Decision margin of bit values (key, bit_idx, v): the lesser mean distance of white and black bits, each count one more."""
    white, black = F.col("v") > 0, F.col("v") <= 0
    w = F.sum(F.when(white, F.col("v")).otherwise(0.0)) / (1 + F.count(F.when(white, 1)))
    b = F.sum(F.when(black, -F.col("v")).otherwise(0.0)) / (1 + F.count(F.when(black, 1)))
    return values.groupBy(*key).agg(F.least(w, b).alias("margin"))


def code_word(values: DataFrame, key: list[str], nbits: int) -> DataFrame:
    """The code word of bit values (key, bit_idx, v): bit 0 is the highest."""
    return values.groupBy(*key).agg(F.sum(F.when(F.col("v") > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(nbits - 1) - F.col("bit_idx"))).otherwise(0)).alias("rcode"))


def hamming_histogram(detections: DataFrame, bins: int = 10) -> DataFrame:
    """Detections of each image by wrong bits, with a row of totals (image_id null)."""
    return detections.rollup("image_id").agg(*[F.count(F.when(F.col("hamming") == k, 1)).alias(f"h{k}") for k in range(bins)], F.count(F.lit(1)).alias("n"))


def best_format(formats: DataFrame, dimensions: int, bits: int, kind: str) -> DataFrame:
    """The format (name, dimensions, bits, kind) that fits data best: dimensions weigh most, then bits, then kind."""
    score = 128 * F.abs(F.col("dimensions") - dimensions) + F.abs(F.col("bits") - bits) + F.when(F.col("kind") == kind, 0).otherwise(1)
    return formats.agg(F.min(F.struct(score.alias("score"), "name")).alias("m")).select("m.name", "m.score")


def first_rows(rows: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
