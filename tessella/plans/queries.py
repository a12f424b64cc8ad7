"""The registered queries of the image engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions import geometry as g
from ..functions import scalar as s
from ..operators import compare, decode, pixels, regions, signals
from ..sources import families as fam
from ..sources import synthetic
from . import detect as plan
from . import pose as poses

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.from_matrix(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


# --- SQL building blocks: the matrix image px(y, x, v), its size dim(w, h), tiles and the ternary image ---

PX = """px AS (SELECT CAST(vec_id AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x,
    CAST(greatest(0, least(255, floor((CAST(embedding[i] AS DOUBLE) + 0.55) * 230))) AS INTEGER) AS v FROM embeddings, range(1, 65) t(i)),
dim AS (SELECT 64 AS w, CAST(max(vec_id) + 1 AS INTEGER) AS h FROM embeddings)"""
TILES = PX + """,
tile AS (SELECT y // 4 AS ty, x // 4 AS tx, min(v) AS mn, max(v) AS mx FROM px, dim WHERE x < w // 4 * 4 AND y < h // 4 * 4 GROUP BY ALL)"""
NEAR = TILES + """,
near AS (SELECT a.ty, a.tx, min(b.mn) AS mn, max(b.mx) AS mx FROM tile a JOIN tile b ON abs(a.ty - b.ty) <= 1 AND abs(a.tx - b.tx) <= 1 GROUP BY ALL)"""


def ternary_sql(diff: int, partial: bool = False) -> str:
    full = "TRUE" if partial else "x < w // 4 * 4 AND y < h // 4 * 4"
    return NEAR + f""",
ternary AS (SELECT y, x, CASE WHEN mx - mn < {diff} AND ({full}) THEN 127 WHEN v > mn + (mx - mn) // 2 THEN 255 ELSE 0 END AS t, w, h
  FROM px, dim, near WHERE near.ty = least(y // 4, h // 4 - 1) AND near.tx = least(x // 4, w // 4 - 1))"""


DIFF = 150  # a contrast that the matrix image has in part


@query(f"WITH {PX} SELECT y, x, v FROM px")
def pixels_from_matrix(spark, sf_dir):
    return matrix(spark, sf_dir).select("y", "x", "v")


@query(f"WITH {TILES} SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, mn, mx FROM tile")
def tile_minmax(spark, sf_dir):
    return pixels.tile_minmax(matrix(spark, sf_dir)).select("ty", "tx", "mn", "mx")


@query(f"WITH {NEAR} SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, mn, mx FROM near")
def neighbour_minmax(spark, sf_dir):
    return pixels.neighbour_minmax(pixels.tile_minmax(matrix(spark, sf_dir))).select("ty", "tx", "mn", "mx")


@query(f"WITH {ternary_sql(5)} SELECT y, x, t FROM ternary")
def adaptive_threshold(spark, sf_dir):
    return pixels.threshold(matrix(spark, sf_dir)).select("y", "x", "t")


@query(f"WITH {ternary_sql(DIFF)} SELECT y, x, t FROM ternary")
def adaptive_threshold_contrast(spark, sf_dir):
    return pixels.threshold(matrix(spark, sf_dir), DIFF).select("y", "x", "t")


def cropped(spark, sf_dir):
    """The matrix image less three columns and a row, so that it ends in partial tiles."""
    return matrix(spark, sf_dir).where("x < w - 3 and y < h - 1").withColumns({"w": F.col("w") - 3, "h": F.col("h") - 1})


CROP = ternary_sql(DIFF, True).replace("FROM embeddings, range(1, 65) t(i))", "FROM embeddings, range(1, 62) t(i) WHERE vec_id < (SELECT max(vec_id) FROM embeddings))").replace("SELECT 64 AS w, CAST(max(vec_id) + 1 AS", "SELECT 61 AS w, CAST(max(vec_id) AS")


@query(f"WITH {CROP} SELECT y, x, t FROM ternary")
def adaptive_threshold_partial_contrast(spark, sf_dir):
    return pixels.threshold(cropped(spark, sf_dir), DIFF, True).select("y", "x", "t")


@query(f"WITH {CROP.replace('AND (TRUE)', 'AND x < w // 4 * 4 AND y < h // 4 * 4')} SELECT y, x, t FROM ternary")
def adaptive_threshold_partial_tiles(spark, sf_dir):
    return pixels.threshold(cropped(spark, sf_dir), DIFF).select("y", "x", "t")


@query(f"WITH {PX} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, v FROM px WHERE x % 2 = 0 AND y % 2 = 0")
def decimate_2(spark, sf_dir):
    return pixels.decimate(matrix(spark, sf_dir), 2).select("y", "x", "v")


_BLEND = " UNION ALL ".join(
    f"SELECT CAST(y // 3 * 2 + {dy} AS INTEGER) AS y, CAST(x // 3 * 2 + {dx} AS INTEGER) AS x, CAST(sum(v * CASE y % 3 * 3 + x % 3 WHEN {c} THEN 4 WHEN {a} THEN 2 WHEN {b} THEN 2 WHEN 4 THEN 1 ELSE 0 END) // 9 AS INTEGER) AS v FROM px, dim WHERE x < w // 3 * 3 AND y < h // 3 * 3 GROUP BY y // 3, x // 3"
    for dx, dy, c, a, b in ((0, 0, 0, 1, 3), (1, 0, 2, 1, 5), (0, 1, 6, 3, 7), (1, 1, 8, 5, 7))
)


@query(f"WITH {PX} {_BLEND}")
def decimate_1_5(spark, sf_dir):
    return pixels.decimate(matrix(spark, sf_dir), 1.5).select("y", "x", "v")


SIGMA = 0.8
_K = pixels.gaussian_kernel(SIGMA, pixels.kernel_size(SIGMA))


def _conv_sql(source: str, along: str, across: str, size: str, name: str, keep: str = "") -> str:
    n, half = len(_K), len(_K) // 2
    total = " + ".join(f"{c} * {'lag' if j < half else 'lead'}(v, {abs(j - half)}) OVER w{name}" for j, c in enumerate(_K))
    return f"{name} AS (SELECT y, x{keep}, CASE WHEN {along} >= {half} AND {along} < {size} - {n} + {half} THEN CAST(({total}) // 256 AS INTEGER) ELSE v END AS v FROM {source}, dim WINDOW w{name} AS (PARTITION BY {across} ORDER BY {along}))"


@query(f"WITH {PX}, {_conv_sql('px', 'x', 'y', 'w', 'a')}, {_conv_sql('a', 'y', 'x', 'h', 'b')} SELECT y, x, v FROM b")
def gaussian_blur(spark, sf_dir):
    return pixels.gaussian_blur(matrix(spark, sf_dir), SIGMA).select("y", "x", "v")


@query(f"WITH {PX}, {_conv_sql('px', 'x', 'y', 'w', 'a')}, {_conv_sql('a', 'y', 'x', 'h', 'b')} SELECT y, x, CAST(greatest(0, least(255, 2 * px.v - b.v)) AS INTEGER) AS v FROM px JOIN b USING (y, x)")
def unsharp_mask(spark, sf_dir):
    return pixels.unsharp(matrix(spark, sf_dir), SIGMA).select("y", "x", "v")


@query(f"WITH {PX} SELECT y, x, CAST(v // 2 AS INTEGER) AS v FROM px")
def darken(spark, sf_dir):
    return pixels.darken(matrix(spark, sf_dir)).select("y", "x", "v")


_AROUND = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"


@query(f"""WITH {ternary_sql(DIFF)},
wide AS (SELECT a.y, a.x, CASE WHEN a.x > 0 AND a.y > 0 AND a.x < any_value(a.w) - 1 AND a.y < any_value(a.h) - 1 THEN max(b.t) ELSE 0 END AS d FROM ternary a JOIN ternary b ON {_AROUND} AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.y, a.x),
thin AS (SELECT a.y, a.x, min(b.d) AS d FROM wide a JOIN wide b ON {_AROUND} AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.y, a.x)
SELECT y, x, CASE WHEN x > 0 AND y > 0 AND x < w - 1 AND y < h - 1 THEN d ELSE t END AS t FROM ternary JOIN thin USING (y, x)""")
def deglitch_dilate_erode(spark, sf_dir):
    return pixels.deglitch(pixels.threshold(matrix(spark, sf_dir), DIFF)).select("y", "x", "t")


@query(f"""WITH {PX}, own AS (SELECT y, x, v, y // 32 AS ty, x // 32 AS tx, 2 * (y % 2) + x % 2 AS p FROM px),
tile AS (SELECT p, ty, tx, min(v) AS mn, max(v) AS mx FROM own GROUP BY ALL),
near AS (SELECT a.p, a.ty, a.tx, min(b.mn) AS mn, max(b.mx) AS mx FROM tile a JOIN tile b ON a.p = b.p AND abs(a.ty - b.ty) <= 1 AND abs(a.tx - b.tx) <= 1 GROUP BY ALL)
SELECT y, x, CASE WHEN v > mn + (mx - mn) // 2 THEN 255 ELSE 0 END AS t FROM own JOIN near USING (p, ty, tx)""")
def bayer_threshold(spark, sf_dir):
    return pixels.bayer_threshold(matrix(spark, sf_dir)).select("y", "x", "t")


def ternary(spark, sf_dir):
    return pixels.threshold(matrix(spark, sf_dir), DIFF)


# pixels of a row that touch are one run; labels spread along links of runs until nothing changes; a link is listed both ways
COMPONENTS = "RECURSIVE " + ternary_sql(DIFF) + """,
node AS (SELECT y * 64 + x AS id, y, x, t FROM ternary WHERE t <> 127),
cut AS (SELECT *, CASE WHEN x BETWEEN 1 AND 62 AND lag(x) OVER r = x - 1 AND lag(t) OVER r = t THEN 0 ELSE 1 END AS begins FROM node WINDOW r AS (PARTITION BY y ORDER BY x)),
numbered AS (SELECT id, y, x, t, sum(begins) OVER (PARTITION BY y ORDER BY x) AS k FROM cut),
run AS (SELECT id, y, x, t, min(id) OVER (PARTITION BY y, k) AS run FROM numbered),
half AS (SELECT DISTINCT a.run AS a, b.run AS b FROM run a JOIN run b ON b.y = a.y - 1 AND a.t = b.t AND a.x BETWEEN 1 AND 62 AND (b.x = a.x OR (a.t = 255 AND b.x IN (a.x - 1, a.x + 1)))),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
flow(run, rep) USING KEY (run) AS (
  SELECT DISTINCT run, run FROM run
  UNION
  SELECT l.a AS run, min(s.rep) AS rep FROM link l JOIN flow s ON s.run = l.b JOIN recurring.flow r ON r.run = l.a WHERE s.rep < r.rep GROUP BY l.a),
spread AS (SELECT run.id AS id, flow.rep AS rep FROM run JOIN flow USING (run))"""


@query(f"WITH {COMPONENTS} SELECT CAST(id AS BIGINT) AS pixel_id, CAST(rep AS BIGINT) AS rep FROM spread")
def components(spark, sf_dir):
    return regions.components(ternary(spark, sf_dir)).select("pixel_id", "rep")


@query(f"WITH {COMPONENTS} SELECT CAST(rep AS BIGINT) AS rep, count(*) AS size FROM spread GROUP BY rep")
def component_sizes(spark, sf_dir):
    return regions.component_sizes(regions.components(ternary(spark, sf_dir))).select("rep", "size")


MIN_SIZE = 8
BOUNDARY = COMPONENTS + f""",
big AS (SELECT rep FROM spread GROUP BY rep HAVING count(*) >= {MIN_SIZE}),
own AS (SELECT n.y, n.x, n.t, CAST(s.rep AS BIGINT) AS rep FROM node n JOIN spread s ON s.id = n.id WHERE s.rep IN (SELECT rep FROM big)),
step(dx, dy) AS (VALUES (1, 0), (0, 1), (-1, 1), (1, 1)),
hit AS (SELECT a.y, a.x, dx, dy, a.t AS t0, b.t AS t1, a.rep AS r0, b.rep AS r1 FROM own a, step, dim, own b
  WHERE a.x BETWEEN 1 AND w - 2 AND a.y BETWEEN 1 AND h - 2 AND b.y = a.y + dy AND b.x = a.x + dx AND a.t + b.t = 255),
point AS (SELECT least(r0, r1) AS lo, greatest(r0, r1) AS hi, 2 * x + dx AS x, 2 * y + dy AS y, dx * (t1 - t0) AS gx, dy * (t1 - t0) AS gy FROM hit p
  WHERE NOT (dx = -1 AND EXISTS (SELECT 1 FROM hit q WHERE q.dx = 1 AND q.dy = 1 AND q.y = p.y AND q.x = p.x - 1)))"""


def points(spark, sf_dir):
    t = ternary(spark, sf_dir)
    return regions.boundary_points(t, regions.components(t), MIN_SIZE)


@query(f"WITH {BOUNDARY} SELECT * FROM point")
def boundary_points(spark, sf_dir):
    return points(spark, sf_dir).drop("image_id")


_CLUSTERS = BOUNDARY + """,
box AS (SELECT lo, hi, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, sum(gx) AS sgx, sum(gy) AS sgy, sum(x * gx + y * gy) AS s FROM point GROUP BY lo, hi)"""
_DOT = "round(CAST(s AS DOUBLE) - CAST(CAST((x0 + x1) * CAST(0.5 AS DOUBLE) + CAST(0.05118 AS DOUBLE) AS FLOAT) AS DOUBLE) * CAST(sgx AS DOUBLE) - CAST(CAST((y0 + y1) * CAST(0.5 AS DOUBLE) - CAST(0.028581 AS DOUBLE) AS FLOAT) AS DOUBLE) * CAST(sgy AS DOUBLE), 3)"


@query(f"WITH {_CLUSTERS} SELECT lo, hi, n, x0, x1, y0, y1, {_DOT} AS dot FROM box")
def clusters(spark, sf_dir):
    return regions.clusters(points(spark, sf_dir)).drop("image_id")


@query(f"WITH {_CLUSTERS} SELECT lo, hi, n FROM box, dim WHERE n BETWEEN 24 AND 2 * (2 * w + 2 * h) AND (x1 - x0) * (y1 - y0) >= 8")
def cluster_gate(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).cast("int")).first()[0]
    return regions.gate(regions.clusters(points(spark, sf_dir)), 64, h, 8).select("lo", "hi", "n")


# --- sequences: the matrix image's rows as circular signals, with idx = x ---


def signal(spark, sf_dir):
    return matrix(spark, sf_dir).select("y", F.col("x").alias("idx"), F.col("v").cast("double").alias("v"))


_TAPS = signals.taps()
_SMOOTH = " + ".join(f"list_extract(s, CAST((idx + {k - len(_TAPS) // 2} + 64) % 64 + 1 AS BIGINT)) * CAST({w!r} AS DOUBLE)" for k, w in enumerate(_TAPS))


@query(f"WITH {PX}, seq AS (SELECT y, list(CAST(v AS DOUBLE) ORDER BY x) AS s FROM px GROUP BY y) SELECT y, CAST(idx AS INTEGER) AS idx, round({_SMOOTH}, 6) AS smooth FROM seq, range(0, 64) t(idx)")
def circular_smooth(spark, sf_dir):
    return signals.smooth(signal(spark, sf_dir), ["y"], "v").select("y", "idx", F.round("smooth", 6).alias("smooth"))


_PEAKS = f"{PX}, peak AS (SELECT y, x AS idx, CAST(v AS DOUBLE) AS v FROM (SELECT *, coalesce(lag(v) OVER o, last_value(v) OVER e) AS b, coalesce(lead(v) OVER o, first_value(v) OVER e) AS a FROM px WINDOW o AS (PARTITION BY y ORDER BY x), e AS (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE v > b AND v > a)"


@query(f"WITH {_PEAKS} SELECT * FROM peak")
def circular_local_maxima(spark, sf_dir):
    return signals.local_maxima(signal(spark, sf_dir), ["y"], "v")


@query(f"WITH {_PEAKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC) AS r FROM peak), cut AS (SELECT y, max(v) AS c FROM ranked WHERE r = 11 GROUP BY y) SELECT y, idx, v FROM ranked LEFT JOIN cut USING (y) WHERE c IS NULL OR v > c")
def topk_maxima(spark, sf_dir):
    return signals.top_k(signals.local_maxima(signal(spark, sf_dir), ["y"], "v"), ["y"], "v", 10)


def weighted(spark, sf_dir):
    """Rows of the matrix image as clusters of points on a grid, weighted by value plus one."""
    m = matrix(spark, sf_dir)
    return m.select("image_id", F.col("y").cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"), F.expr("x * 2").alias("x"), F.expr("(v * 7 + x) % 128").alias("y"), F.lit(0).alias("gx"), F.lit(0).alias("gy"), F.col("x").cast("float").alias("slope"), (F.col("v") + 1).cast("double").alias("wt"))


_MOMENTS = PX + """, pt AS (SELECT y AS lo, x AS idx, x * 2 * CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS fx, (v * 7 + x) % 128 * CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS fy, CAST(v + 1 AS DOUBLE) AS wt FROM px),
moment AS (SELECT lo, idx, sum(fx * wt) OVER c AS mx, sum(fy * wt) OVER c AS my, sum(fx * fx * wt) OVER c AS mxx, sum(fx * fy * wt) OVER c AS mxy, sum(fy * fy * wt) OVER c AS myy, sum(wt) OVER c AS w FROM pt WINDOW c AS (PARTITION BY lo ORDER BY idx ROWS UNBOUNDED PRECEDING))"""
_SIX = ("mx", "my", "mxx", "mxy", "myy", "w")


@query(f"WITH {_MOMENTS} SELECT CAST(lo AS BIGINT) AS lo, CAST(idx AS INTEGER) AS idx, {', '.join(f'round({c}, 3) AS {c}' for c in _SIX)} FROM moment")
def prefix_moments(spark, sf_dir):
    m = regions.prefix_moments(weighted(spark, sf_dir))
    return m.select("lo", F.col("idx").cast("int").alias("idx"), *[F.round(c, 3).alias(c) for c in _SIX])


@query(f"""WITH {_MOMENTS}, r(i0, i1) AS (VALUES (3, 20), (50, 9), (0, 63)),
sums AS (SELECT lo, i0, i1, i1 - i0 + 1 + CASE WHEN i1 < i0 THEN 64 ELSE 0 END AS n, {', '.join(f'e.{c} - coalesce(b.{c}, 0) + CASE WHEN i1 < i0 THEN z.{c} ELSE 0 END AS {c}' for c in _SIX)}
  FROM r JOIN moment e ON e.idx = i1 JOIN moment z USING (lo) LEFT JOIN moment b ON b.lo = e.lo AND b.idx = i0 - 1 WHERE z.idx = 63),
c AS (SELECT *, mx / w AS ex, my / w AS ey, mxx / w - mx / w * (mx / w) AS cxx, mxy / w - mx / w * (my / w) AS cxy, myy / w - my / w * (my / w) AS cyy FROM sums),
l AS (SELECT *, sqrt((cxx - cyy) * (cxx - cyy) + 4 * cxy * cxy) AS root FROM c)
SELECT CAST(lo AS BIGINT) AS lo, i0, i1, CAST(n AS INTEGER) AS n, round(ex, 4) AS ex, round(ey, 4) AS ey, round((cxx + cyy - root) / 2, 4) AS mse FROM l""")
def range_line_fit(spark, sf_dir):
    m = regions.prefix_moments(weighted(spark, sf_dir))
    ranges = m.select("image_id", "lo", "hi").distinct().select("*", F.inline(F.array(*[F.struct(F.lit(a).alias("i0"), F.lit(b).alias("i1")) for a, b in ((3, 20), (50, 9), (0, 63))])))
    return regions.range_fit(m, ranges).select("lo", "i0", "i1", F.col("n").cast("int").alias("n"), *[F.round(c, 4).alias(c) for c in ("ex", "ey", "mse")])


# --- families and decoding ---

_SMALL = ("tag16h5", "tag25h9", "tagCircle21h7")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else "CAST(NULL AS INTEGER)" if c is None else str(c).upper() if isinstance(c, bool) else str(c) for c in r) + ")" for r in rows)


_CODES = _values((n, i, c) for n in _SMALL for i, c in enumerate(fam.family(n).codes))
_BITS = _values((n, i, x, y) for n in _SMALL for i, (x, y) in enumerate(fam.family(n).bits))
_FAMILIES = _values((n, nb, h, b, t, r, len(fam.CODES.get(n, "").split())) for n, nb, h, b, t, r, _ in fam.LAYOUTS)
_FAM_COLUMNS = "family, nbits, min_hamming, width_at_border, total_width, reversed_border, ncodes"


@query(f"SELECT * FROM (VALUES {_FAMILIES}) f({_FAM_COLUMNS})")
def family_catalog(spark, sf_dir):
    return fam.families(spark)


@query(f"""WITH f({_FAM_COLUMNS}) AS (VALUES {_FAMILIES}), c(family, id, code) AS (VALUES {_CODES}), b(family, bit, bitx, bity) AS (VALUES {_BITS}),
cell AS (SELECT family, nbits, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, (total_width - width_at_border) // 2 AS o,
    (total_width - width_at_border - CASE WHEN reversed_border THEN 0 ELSE 2 END) // 2 AS a, total_width - 1 - (total_width - width_at_border - CASE WHEN reversed_border THEN 0 ELSE 2 END) // 2 AS z
  FROM f, range(0, 16) u(y), range(0, 16) v(x) WHERE x < total_width AND y < total_width)
SELECT cell.family, c.id, cell.y, cell.x, CASE WHEN (x IN (a, z) AND y BETWEEN a AND z) OR (y IN (a, z) AND x BETWEEN a AND z)
    OR (bit IS NOT NULL AND (CAST(code AS BIGINT) >> (nbits - 1 - coalesce(bit, 0))) & 1 = 1) THEN 255 ELSE 0 END AS v
FROM cell JOIN c ON c.family = cell.family LEFT JOIN b ON b.family = cell.family AND b.bitx + o = x AND b.bity + o = y""")
def render_tag(spark, sf_dir):
    return decode.render(spark, _SMALL)


def words(spark, sf_dir):
    """Code words to decode, one for each part: a tag16h5 word with up to three bits flipped, or a random word."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    codes = F.array(*[F.lit(c).cast("bigint") for c in fam.family("tag16h5").codes])
    code = F.element_at(codes, (F.col("k") % 30 + 1).cast("int"))
    flips = [F.when(F.col("k") % 5 > i, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.expr(f"cast((k div 7 + {5 * i}) % 16 as int)"))).otherwise(0) for i in range(3)]
    for f in flips:
        code = code.bitwiseXOR(f)
    return p.select("k", F.when(F.col("k") % 5 == 4, F.col("k") * 40503 % 65536).otherwise(code).alias("rcode"))


_WORDS = "w AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 4 THEN p_partkey * 40503 % 65536 ELSE xor(xor(xor(CAST(code AS BIGINT), " + "), ".join(f"CASE WHEN p_partkey % 5 > {i} THEN CAST(1 AS BIGINT) << CAST((p_partkey // 7 + {5 * i}) % 16 AS BIGINT) ELSE 0 END" for i in range(3)) + ") END AS rcode FROM part JOIN c ON c.family = 'tag16h5' AND c.id = p_partkey % 30)"


def _decode_sql(k: int) -> str:
    turn = "((q << 4) | (q >> 12)) & 65535"
    return f"""WITH c(family, id, code) AS (VALUES {_CODES}), {_WORDS},
r0 AS (SELECT k, rcode, rcode AS q FROM w), r1 AS (SELECT k, rcode, {turn} AS q FROM r0), r2 AS (SELECT k, rcode, {turn} AS q FROM r1), r3 AS (SELECT k, rcode, {turn} AS q FROM r2),
turned AS (SELECT *, 0 AS rotation FROM r0 UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3),
hit AS (SELECT k, rcode, rotation, id, CAST(bit_count(xor(q, CAST(code AS BIGINT))) AS INTEGER) AS hamming FROM turned JOIN c ON c.family = 'tag16h5' WHERE bit_count(xor(q, CAST(code AS BIGINT))) <= {k})
SELECT k, rcode, id, hamming, rotation FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rotation, id) AS r FROM hit) WHERE r = 1"""


@query(_decode_sql(0))
def decode_exact(spark, sf_dir):
    return decode.lookup(words(spark, sf_dir), "tag16h5", 0)


@query(_decode_sql(2))
def decode_hamming2(spark, sf_dir):
    return decode.lookup(words(spark, sf_dir), "tag16h5", 2)


@query(f"WITH c(family, id, code) AS (VALUES {_CODES}) SELECT family, id, CASE family WHEN 'tag16h5' THEN ((q << 4) | (q >> 12)) & 65535 WHEN 'tag25h9' THEN (((q >> 1 << 6) | (q >> 1 >> 18)) & 16777215) << 1 | (q & 1) ELSE (((q >> 1 << 5) | (q >> 1 >> 15)) & 1048575) << 1 | (q & 1) END AS turned FROM (SELECT family, id, CAST(code AS BIGINT) AS q FROM c)")
def rotate90(spark, sf_dir):
    c = fam.family_codes(spark, _SMALL)
    turned = F.coalesce(*[F.when(F.col("family") == n, decode.rotate90(F.col("code"), fam.family(n).nbits)) for n in _SMALL])
    return c.select("family", "id", turned.alias("turned"))


@query(f"""WITH {PX}, sm AS (SELECT y // 10 AS k, CAST(x AS DOUBLE) / 32 - 1 AS x, CAST(y % 10 AS DOUBLE) / 5 - 1 AS y, CAST(v AS DOUBLE) AS v FROM px),
s AS (SELECT k, sum(x*x) AS a, sum(x*y) AS b, sum(x) AS c, sum(y*y) AS d, sum(y) AS e, CAST(count(*) AS DOUBLE) AS n, sum(x*v) AS p, sum(y*v) AS q, sum(v) AS r FROM sm GROUP BY k),
t AS (SELECT *, a * (d * n - e * e) - b * (b * n - e * c) + c * (b * e - d * c) AS det FROM s)
SELECT CAST(k AS BIGINT) AS k, round((p * (d * n - e * e) - b * (q * n - e * r) + c * (q * e - d * r)) / det, 6) AS c0, round((a * (q * n - e * r) - p * (b * n - e * c) + c * (b * r - q * c)) / det, 6) AS c1, round((a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det, 6) AS c2 FROM t""")
def gray_model_fit(spark, sf_dir):
    m = matrix(spark, sf_dir).select(F.expr("y div 10").alias("k"), (F.col("x") / 32 - 1).alias("x"), (F.col("y") % 10 / 5 - 1).alias("y"), F.col("v").cast("double").alias("v"))
    return decode.gray_model(m, ["k"]).select("k", *[F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")])


def bits(spark, sf_dir):
    """Four words of 16 bits in each row."""
    return matrix(spark, sf_dir).select("y", F.expr("x div 16").alias("word"), (F.col("x") % 16).alias("bit_idx"), (F.col("v") - 127.5).alias("v"))


_BITVALUES = f"{PX}, bv AS (SELECT y, CAST(x // 16 AS BIGINT) AS word, x % 16 AS i, v - CAST(127.5 AS DOUBLE) AS v FROM px)"


@query(f"WITH {_BITVALUES} SELECT y, word, round(least(coalesce(sum(v) FILTER (WHERE v > 0), 0) / (1 + count(*) FILTER (WHERE v > 0)), coalesce(sum(-v) FILTER (WHERE v <= 0), 0) / (1 + count(*) FILTER (WHERE v <= 0))), 6) AS margin FROM bv GROUP BY y, word")
def decision_margin(spark, sf_dir):
    return decode.margin(bits(spark, sf_dir), ["y", "word"]).select("y", "word", F.round("margin", 6).alias("margin"))


@query(f"WITH {_BITVALUES} SELECT y, word, CAST(sum(CASE WHEN v > 0 THEN CAST(1 AS BIGINT) << (15 - i) ELSE 0 END) AS BIGINT) AS rcode FROM bv GROUP BY y, word")
def code_word(spark, sf_dir):
    return decode.code_word(bits(spark, sf_dir), ["y", "word"], 16)


@query("""WITH v AS (SELECT vec_id AS quad, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))
SELECT a.quad, a.y, a.x, round(a.v + 0.25 * (4 * a.v - coalesce(sum(b.v), 0)), 6) AS v FROM v a LEFT JOIN v b ON a.quad = b.quad AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.quad, a.y, a.x, a.v""")
def sharpen(spark, sf_dir):
    """Each vector as a patch of 8 x 8 values."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("quad"), F.posexplode("embedding").alias("i", "v"))
    e = e.select("quad", F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("v"))
    return pixels.sharpen(e, 0.25).select("quad", "y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {PX}, p AS (SELECT c_custkey AS k, (c_custkey * 37 % 6500) / CAST(100 AS DOUBLE) - 0.5 AS qx, (c_custkey * 91 % 20100) / CAST(100 AS DOUBLE) - 0.5 AS qy FROM customer),
four AS (SELECT k, CAST(floor(qx) AS INTEGER) AS x, CAST(floor(qy) AS INTEGER) AS y, (1 - (qx - floor(qx))) * (1 - (qy - floor(qy))) AS w FROM p
  UNION ALL SELECT k, CAST(floor(qx) AS INTEGER), CAST(ceil(qy) AS INTEGER), (1 - (qx - floor(qx))) * (qy - floor(qy)) FROM p
  UNION ALL SELECT k, CAST(ceil(qx) AS INTEGER), CAST(floor(qy) AS INTEGER), (qx - floor(qx)) * (1 - (qy - floor(qy))) FROM p
  UNION ALL SELECT k, CAST(ceil(qx) AS INTEGER), CAST(ceil(qy) AS INTEGER), (qx - floor(qx)) * (qy - floor(qy)) FROM p)
SELECT k, round(sum(v * w), 4) AS v FROM four JOIN px USING (x, y) GROUP BY k HAVING count(*) = 4""")
def bilinear_sample(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.lit("matrix").alias("image_id"), F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 37 % 6500 / F.lit(100.0)).alias("px"), (F.col("c_custkey") * 91 % 20100 / F.lit(100.0)).alias("py"))
    return pixels.sample(matrix(spark, sf_dir), p).select(F.col("point_id").alias("k"), F.round("v", 4).alias("v"))


# --- geometry on columns: quads made from part keys ---


def polygons(spark, sf_dir):
    """A square-like quad for each part, its size, place and skew taken from the key."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    a, b, c = (F.pmod(F.col("k") * m, F.lit(n)).cast("double") for m, n in ((7, 40), (13, 40), (5, 9)))
    side = F.pmod(F.col("k"), F.lit(17)).cast("double") + 3
    pts = [(a, b), (a + side, b + c / 4), (a + side - c / 3, b + side), (a + c / 5, b + side - 1)]
    return p.select("k", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts]).alias("p"))


_POLY = "q AS (SELECT k, a AS x1, b AS y1, a + s AS x2, b + c / 4 AS y2, a + s - c / 3 AS x3, b + s AS y3, a + c / 5 AS x4, b + s - 1 AS y4 FROM (SELECT p_partkey AS k, CAST(p_partkey * 7 % 40 AS DOUBLE) AS a, CAST(p_partkey * 13 % 40 AS DOUBLE) AS b, CAST(p_partkey * 5 % 9 AS DOUBLE) AS c, CAST(p_partkey % 17 + 3 AS DOUBLE) AS s FROM part))"


def _turn_sql(i: int, j: int, k: int) -> str:
    dot = f"((x{j}-x{i})*(x{k}-x{j}) + (y{j}-y{i})*(y{k}-y{j}))"
    size = f"sqrt(((x{j}-x{i})*(x{j}-x{i}) + (y{j}-y{i})*(y{j}-y{i})) * ((x{k}-x{j})*(x{k}-x{j}) + (y{k}-y{j})*(y{k}-y{j})))"
    return f"abs({dot} / {size}) <= {math.cos(math.radians(10))!r} AND (x{j}-x{i})*(y{k}-y{j}) >= (y{j}-y{i})*(x{k}-x{j})"


@query(f"WITH {_POLY} SELECT k, round(abs((x1*y2 - x2*y1) + (x2*y3 - x3*y2) + (x3*y4 - x4*y3) + (x4*y1 - x1*y4)) / 2, 6) AS area FROM q WHERE abs((x1*y2 - x2*y1) + (x2*y3 - x3*y2) + (x3*y4 - x4*y3) + (x4*y1 - x1*y4)) / 2 >= 0.95 * 64 AND {' AND '.join(_turn_sql(i, i % 4 + 1, (i + 1) % 4 + 1) for i in range(1, 5))}")
def quad_filters(spark, sf_dir):
    p = polygons(spark, sf_dir)
    limit = math.cos(math.radians(10))

    def turn(i):
        a, b, c = (F.element_at("p", F.pmod(i + k, F.lit(4)) + 1) for k in range(3))
        x1, y1, x2, y2 = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        return (F.abs((x1 * x2 + y1 * y2) / F.sqrt((x1 * x1 + y1 * y1) * (x2 * x2 + y2 * y2))) <= limit) & (x1 * y2 >= y1 * x2)

    good = p.withColumn("area", F.abs(g.signed_area(F.col("p")))).where((F.col("area") >= 0.95 * 64) & F.forall(F.sequence(F.lit(0), F.lit(3)), turn))
    return good.select("k", F.round("area", 6).alias("area"))


@query(f"""WITH {_POLY}, pt AS (SELECT *, CAST(k * 3 % 50 AS DOUBLE) + 0.25 AS u, CAST(k * 11 % 50 AS DOUBLE) + 0.25 AS v FROM q),
side AS (SELECT k, u, v, unnest([{{'ax': x1, 'ay': y1, 'bx': x2, 'by': y2}}, {{'ax': x2, 'ay': y2, 'bx': x3, 'by': y3}}, {{'ax': x3, 'ay': y3, 'bx': x4, 'by': y4}}, {{'ax': x4, 'ay': y4, 'bx': x1, 'by': y1}}]) AS s FROM pt)
SELECT k, sum(CASE WHEN (s.ay > v) <> (s.by > v) AND u < (s.bx - s.ax) * (v - s.ay) / nullif(s.by - s.ay, 0) + s.ax THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM side GROUP BY k""")
def polygon_contains_point(spark, sf_dir):
    at = F.struct((F.col("k") * 3 % 50 + 0.25).alias("x"), (F.col("k") * 11 % 50 + 0.25).alias("y"))
    return polygons(spark, sf_dir).select("k", g.contains_point(F.col("p"), at).alias("inside"))


def _crosses(i: int, j: int) -> str:
    a, b, c, d = i, i % 4 + 1, j, j % 4 + 1
    det = f"((a.x{b}-a.x{a})*(b.y{d}-b.y{c}) - (a.y{b}-a.y{a})*(b.x{d}-b.x{c}))"
    s1 = f"(((b.x{c}-a.x{a})*(b.y{d}-b.y{c}) - (b.y{c}-a.y{a})*(b.x{d}-b.x{c})) / nullif({det}, 0))"
    s2 = f"(((b.x{c}-a.x{a})*(a.y{b}-a.y{a}) - (b.y{c}-a.y{a})*(a.x{b}-a.x{a})) / nullif({det}, 0))"
    return f"coalesce(abs({det}) >= 1e-8 AND {s1} BETWEEN 0 AND 1 AND {s2} BETWEEN 0 AND 1, FALSE)"


@query(f"WITH {_POLY} SELECT a.k, ({' OR '.join(_crosses(i, j) for i in range(1, 5) for j in range(1, 5))}) AS crossed FROM q a JOIN q b ON b.k = a.k + 1")
def polygon_intersects(spark, sf_dir):
    p = polygons(spark, sf_dir)
    other = p.select((F.col("k") - 1).alias("k"), F.col("p").alias("o"))
    return p.join(other, "k").select("k", g.polygons_intersect(F.col("p"), F.col("o")).alias("crossed"))


@query()
def polygon_overlaps(spark, sf_dir):
    p = polygons(spark, sf_dir)
    other = p.select((F.col("k") - 1).alias("k"), F.col("p").alias("o"))
    return p.join(other, "k").select("k", g.overlaps(F.col("p"), F.col("o")).alias("overlaps"), g.contains_polygon(F.col("p"), F.col("o")).alias("contains"))


# --- reports ---


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type""")
def timing_stats(spark, sf_dir):
    return compare.stats(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_STAMPS = "SELECT event_id, user_id, epoch_us(ts) AS utime FROM events"


@query(f"SELECT event_id, coalesce(utime - lag(utime) OVER w, 0) AS delta, utime - first_value(utime) OVER w AS total FROM ({_STAMPS}) WINDOW w AS (PARTITION BY user_id ORDER BY utime, event_id)")
def stage_deltas(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("utime"))
    return compare.stage_deltas(e, "user_id", ["utime", "event_id"], "utime").select("event_id", F.coalesce("delta", F.lit(0)).alias("delta"), "total")


@query(f"SELECT user_id, max(utime) - min(utime) AS total FROM ({_STAMPS}) GROUP BY user_id")
def stage_total(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("utime"))
    return compare.total_time(e, "user_id", "utime")


@query("SELECT user_id, CAST(max(s) AS BIGINT) AS peak FROM (SELECT user_id, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 2 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) GROUP BY user_id")
def memory_high_water(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(2).alias("size"))
    return compare.high_water(e, "user_id", ["event_id"], "size")


_HALF = "SELECT p_size AS id, p_partkey AS k, p_retailprice AS v, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS pos FROM part WHERE p_partkey % 2 = "


@query(f"SELECT id, pos, coalesce(a.k, -1) AS a_k, coalesce(b.k, -1) AS b_k, coalesce(a.v, -1) AS a_v, coalesce(b.v, -1) AS b_v, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'both' END AS status FROM ({_HALF}0) a FULL JOIN ({_HALF}1) b USING (id, pos)")
def compare_runs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("id"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    return compare.pair_by_id(p.where("k % 2 = 0"), p.where("k % 2 = 1"), "id", ["k"], ["k", "v"]).withColumn("pos", F.col("pos").cast("bigint")).na.fill(-1, ["a_k", "b_k", "a_v", "b_v"])


@query("SELECT p_size AS v, 'a' AS side FROM (SELECT p_size FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_size FROM part WHERE p_partkey % 2 = 1) UNION ALL SELECT p_size, 'b' FROM (SELECT p_size FROM part WHERE p_partkey % 2 = 1 EXCEPT ALL SELECT p_size FROM part WHERE p_partkey % 2 = 0)")
def symmetric_difference(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("v"), F.col("p_partkey").alias("k"))
    return compare.differences(p.where("k % 2 = 0").select("v"), p.where("k % 2 = 1").select("v"))


@query("SELECT CAST(user_id AS VARCHAR) AS image_id, " + ", ".join(f"count(*) FILTER (WHERE event_id % 10 = {k}) AS h{k}" for k in range(10)) + ", count(*) AS n FROM events GROUP BY ROLLUP (user_id)")
def hamming_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("image_id"), (F.col("event_id") % 10).alias("hamming"))
    return decode.hamming_histogram(e)


@query("SELECT 'png' AS name, 0 AS score")
def best_save_format(spark, sf_dir):
    f = spark.createDataFrame([("png", 2, 8, "uint"), ("npy", 3, 64, "float"), ("tiff", 3, 16, "uint")], "name string, dimensions int, bits int, kind string")
    return decode.best_format(f, 2, 8, "uint")


# --- scalar batteries ---


@query(r"""SELECT doc_id, CAST(instr(text, 'e') - 1 AS INTEGER) AS first_e, CAST(CASE WHEN instr(reverse(text), 'e') = 0 THEN -1 ELSE length(text) - instr(reverse(text), 'e') END AS INTEGER) AS last_e,
  len(list_filter(string_split(text, ' '), lambda t: t <> '')) AS n_parts, md5(lower(text)) AS low, upper(substring(source, 2, 2)) AS up, starts_with(text, 'The') AS the, ends_with(text, '.') AS dot,
  length(replace(replace(text, 'e', '33'), 'a', '')) AS n_replaced, source IN ('src1', 'src2') AS one_of, length(regexp_replace(regexp_replace('  ' || text || chr(10), '^[ \t\n\x0b\f\r]+', ''), '[ \t\n\x0b\f\r]+$', '')) AS n_stripped, md5(left(text, greatest(length(text) - 1, 0))) AS popped
FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)""")
def string_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    return d.select("doc_id", s.index_of(t, "e").alias("first_e"), s.last_index_of(t, "e").alias("last_e"), F.size(s.split_spaces(t)).cast("bigint").alias("n_parts"), F.md5(F.lower(t)).alias("low"), F.upper(s.substring(F.col("source"), 1, 3)).alias("up"), F.startswith(t, F.lit("The")).alias("the"), F.endswith(t, F.lit(".")).alias("dot"), F.length(s.replace_many(t, "e", "33", "a", "")).cast("bigint").alias("n_replaced"), s.matches_any(F.col("source"), ["src1", "src2"]).alias("one_of"), F.length(s.strip(F.concat(F.lit("  "), t, F.lit("\n")))).cast("bigint").alias("n_stripped"), F.md5(s.pop_back(t)).alias("popped"))


@query("""SELECT event_id, CAST(floor(u / 1000000) AS BIGINT) AS sec, u % 1000000 AS usec, ms * 1000 AS us, (CAST(floor(k % 100 * 100) AS BIGINT) + (k % 10000) // 100 * 6000 + k // 10000 * 360000) * 10000 AS day
FROM (SELECT event_id, epoch_us(ts) AS u, event_id AS ms, event_id % 24 * 10000 + event_id % 60 * 100 + event_id % 59 AS k FROM events)""")
def time_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"), F.expr("event_id % 24 * 10000 + event_id % 60 * 100 + event_id % 59").alias("k"))
    return e.select("event_id", s.seconds(F.col("u")).alias("sec"), s.microseconds(F.col("u")).alias("usec"), s.ms_to_us(F.col("event_id")).alias("us"), s.hhmmss_to_utime(F.col("k").cast("double")).alias("day"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS magnitude, round(list_sum(list_transform(range(1, 65), lambda i: e[i] * e[65 - i])), 6) AS dot, round(list_max(list_transform(range(1, 65), lambda i: abs(e[i] - e[65 - i]))), 6) AS widest,
  len(list_filter(e, lambda x: x > 0)) AS n_positive, round(e[3], 6) AS third FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""")
def vector_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = F.col("e"), F.reverse("e")
    return e.select("vec_id", F.round(s.magnitude(a), 6).alias("magnitude"), F.round(s.dot(a, b), 6).alias("dot"), F.round(s.max_abs_difference(a, b), 6).alias("widest"), F.size(F.filter(a, lambda x: x > 0)).cast("bigint").alias("n_positive"), F.round(s.get(a, 2), 6).alias("third"))


@query(f"""SELECT event_id, CASE WHEN value >= 0 THEN 1 ELSE -1 END AS sgn, round(value - 360 * floor(value / 360), 6) AS m360, round(value + 180 - 360 * floor((value + 180) / 360) - 180, 6) AS s360, round(value - {s.TWO_PI!r} * floor(value / {s.TWO_PI!r}), 6) AS m2pi,
  greatest(-5, least(CAST(value AS DOUBLE), 5)) AS clamped, CAST(sign(value - 50) AS INTEGER) AS cmp, CAST(CASE WHEN event_id <= 1 THEN 0 ELSE length(bin(event_id - 1)) END AS INTEGER) AS log2 FROM events""")
def number_functions(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", s.sign(v).alias("sgn"), F.round(s.mod360_positive(v), 6).alias("m360"), F.round(s.mod360(v), 6).alias("s360"), F.round(s.mod2pi_positive(v), 6).alias("m2pi"), s.clamp(v, -5.0, 5.0).alias("clamped"), s.compare(v, F.lit(50.0)).alias("cmp"), s.ceil_log2(F.col("event_id")).alias("log2"))


@query("SELECT kind AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(CASE kind WHEN 'zero' THEN 0 WHEN 'constant' THEN 9 WHEN 'identity' THEN CASE WHEN x = y THEN 1 ELSE 0 END ELSE (x * 7919 + y * 104729 + 9 * 1299709) * 48271 % 2147483647 % 256 END AS INTEGER) AS v FROM (VALUES ('zero'), ('constant'), ('identity'), ('random')) k(kind), range(0, 30) a(y), range(0, 40) b(x)")
def synthetic_images(spark, sf_dir):
    out = None
    for kind in ("zero", "constant", "identity", "random"):
        p = pixels.synthetic(spark, kind, 40, 30, 9).select("image_id", "y", "x", "v")
        out = p if out is None else out.unionByName(p)
    return out


# --- whole detections ---

_SCENES = _values((f"tag16h5-{i}-{r}", i, r) for i in range(30) for r in range(4))


@query(f"SELECT image_id, 'tag16h5' AS family, id, 0 AS hamming, CAST(70 AS DOUBLE) AS cx, CAST(70 AS DOUBLE) AS cy FROM (VALUES {_SCENES}) t(image_id, id, r)")
def detect_scene(spark, sf_dir):
    """Every tag16h5 marker, ten pixels a cell, at each quarter turn."""
    images = synthetic.scenes(spark, "tag16h5", 10, 30)
    return plan.detect(images, DetectorConfig(families=("tag16h5",), quad_decimate=1.0)).select("image_id", "family", "id", "hamming", F.round("cx", 2).alias("cx"), F.round("cy", 2).alias("cy"))


@query()
def pose_from_corners(spark, sf_dir):
    images = synthetic.scenes(spark, "tag25h9", 10, 30)
    found = plan.detect(images, DetectorConfig(families=("tag25h9",), quad_decimate=1.0))
    return poses.poses(found, 0.1, 300.0, 300.0, 75.0, 75.0)


@query()
def pack_round_trip(spark, sf_dir):
    """Pixels packed to bytes and unpacked again."""
    return pixels.unpack(pixels.pack(matrix(spark, sf_dir))).select("y", "x", "v")


ORACLES["pack_round_trip"] = ORACLES["pixels_from_matrix"]
