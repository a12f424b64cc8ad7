"""More registered queries with their SQL: functions on columns, matrices, projections, quads, files and the like."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions import geometry as g
from ..functions import linalg, polynomial
from ..functions import scalar as s
from ..operators import compare, decode, drawing, pixels, quads
from ..sources import codecs, readers, synthetic
from . import detect as plan
from .queries import _POLY, ORACLES, PX, QUERIES, SIGMA, _conv_sql, _crosses, _values, matrix, polygons, query, table

__all__ = ["ORACLES", "QUERIES"]


def mapped(rows: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """A plain function of one row, applied to Arrow batches."""

    def run(batches):
        for batch in batches:
            out = [f(r) for r in batch.to_pylist()]
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return rows.mapInArrow(run, schema)


# --- functions on columns ---


@query(f"""SELECT event_id, round(value + {math.pi!r} - {2 * math.pi!r} * floor((value + {math.pi!r}) / {2 * math.pi!r}) - {math.pi!r}, 6) AS m2pi,
  round(100 + (value - 100 + {math.pi!r} - {2 * math.pi!r} * floor((value - 100 + {math.pi!r}) / {2 * math.pi!r}) - {math.pi!r}), 6) AS by_ref,
  CAST(floor((value - {2 * math.pi!r} * floor(value / {2 * math.pi!r})) / {2 * math.pi!r} * 12) AS INTEGER) % 12 AS sector, abs(value - 50) < 10 AS near, round(value * value, 6) AS square FROM events""")
def angle_functions(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(s.mod2pi(v), 6).alias("m2pi"), F.round(s.mod2pi_ref(F.lit(100.0), v), 6).alias("by_ref"), s.theta_to_int(v, 12).alias("sector"), s.near(v, F.lit(50.0), 10.0).alias("near"), F.round(s.square(v), 6).alias("square"))


@query(r"""SELECT doc_id, CAST(coalesce(list_min(list_filter(range(0, greatest(1, least(length(text), length(other)))), lambda i: substring(text, i + 1, 1) <> substring(other, i + 1, 1))), least(length(text), length(other))) AS INTEGER) AS differs,
  length(regexp_replace(text || chr(9), '[ \t\n\x0b\f\r]+$', '')) AS n_right, length(regexp_replace(chr(10) || text, '^[ \t\n\x0b\f\r]+', '')) AS n_left, starts_with(text, 'The') OR starts_with(text, 'Die') AS begins, lower(source) = lower(upper(source)) AS same,
  len(list_filter(string_split(text, 'the'), lambda t: t <> '')) AS n_the, md5(replace(text, 'e', 'E')) AS replaced
FROM (SELECT doc_id, source, left(coalesce(text, ''), 200) AS text, replace(left(coalesce(text, ''), 200), 'q', 'Q') AS other FROM documents)""")
def string_functions_more(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("text"))
    t = F.col("text")
    return d.select(
        "doc_id", s.first_difference(t, s.replace(t, "q", "Q")).alias("differs"), F.length(s.rstrip(F.concat(t, F.lit("\t")))).cast("bigint").alias("n_right"), F.length(s.lstrip(F.concat(F.lit("\n"), t))).cast("bigint").alias("n_left"),
        s.starts_with_any(t, ["The", "Die"]).alias("begins"), s.equal_ignoring_case(F.col("source"), F.upper("source")).alias("same"), F.size(s.split_nonempty(t, "the")).cast("bigint").alias("n_the"), F.md5(s.replace(t, "e", "E")).alias("replaced"),
    )


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 10) AS INTEGER)) AS a FROM embeddings)
SELECT vec_id, array_to_string(list_concat(a[1:5], a[7:]), ',') AS removed, CAST(coalesce(list_position(a, 0), 0) - 1 AS BIGINT) AS at_zero, array_to_string(CASE WHEN list_contains(a, 0) THEN list_concat(a[1:list_position(a, 0) - 1], a[list_position(a, 0) + 1:]) ELSE a END, ',') AS without_zero,
  array_to_string(list_concat(list_concat(a[1:2], [99]), a[3:]), ',') AS inserted, array_to_string(list_concat(list_concat(a[1:3], [77]), a[5:]), ',') AS put, array_to_string(a[1:4], ',') AS cut, a[8] AS item, list_contains(a, 3) AS has FROM a""")
def array_functions(spark, sf_dir):
    a = F.transform("embedding", lambda x: F.floor(x * 10).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"))
    a = F.col("a")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return e.select("vec_id", text(s.remove_index(a, 5)).alias("removed"), s.array_index_of(a, 0).alias("at_zero"), text(s.remove_value(a, 0)).alias("without_zero"), text(s.insert(a, 2, 99)).alias("inserted"), text(s.put(a, 3, 77)).alias("put"), text(s.truncate(a, 4)).alias("cut"), s.get(a, 7).alias("item"), F.array_contains(a, 3).alias("has"))


@query("""WITH m AS (SELECT c_custkey AS k, c_nationkey % 5 AS n, CAST(c_custkey % 100 AS BIGINT) AS v FROM customer)
SELECT k, CAST(CASE WHEN n = 2 THEN 1 ELSE 2 END AS INTEGER) AS n_put, CAST(-1 AS BIGINT) AS put, CASE WHEN n = 2 THEN CAST(-1 AS BIGINT) ELSE v END AS own, n = 3 AS gone, n = 1 AS has, v AS got FROM m""")
def map_functions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("n"), (F.col("c_custkey") % 100).cast("bigint").alias("v"))
    m = F.create_map("n", "v")
    put = s.map_put(m, 2, F.lit(-1).cast("bigint"))
    return c.select("k", F.size(put).alias("n_put"), F.element_at(put, 2).alias("put"), F.element_at(put, F.col("n")).alias("own"), (F.size(s.map_remove(m, 3)) == 0).alias("gone"), F.map_contains_key(m, 1).alias("has"), F.element_at(m, F.col("n")).alias("got"))


@query("""SELECT event_id, CAST(floor(u / 1000000) AS BIGINT) AS sec, u % 1000000 AS usec, u % 1000000 * 1000 AS nsec FROM (SELECT event_id, epoch_us(ts) AS u FROM events)""")
def time_structs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    v, n = s.timeval(F.col("u")), s.timespec(F.col("u"))
    return e.select("event_id", v["sec"].alias("sec"), v["usec"].alias("usec"), n["nsec"].alias("nsec"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT vec_id, e[1:3] AS a, e[4:6] AS b FROM e)
SELECT vec_id, round(sqrt((a[1]-b[1])*(a[1]-b[1]) + (a[2]-b[2])*(a[2]-b[2]) + (a[3]-b[3])*(a[3]-b[3])), 6) AS distance, round(a[1] / sqrt(a[1]*a[1] + a[2]*a[2] + a[3]*a[3]), 6) AS unit, round(a[2] * 2.5, 6) AS scaled, round(a[3] + b[3], 6) AS added, round(a[1] - b[1], 6) AS less,
  round(a[2]*b[3] - a[3]*b[2], 6) AS cx, round(a[3]*b[1] - a[1]*b[3], 6) AS cy, round(a[1]*b[2] - a[2]*b[1], 6) AS cz FROM v""")
def vector_functions_more(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = F.slice("e", 1, 3), F.slice("e", 4, 3)
    cross = s.cross(a, b)
    return e.select("vec_id", F.round(s.vector_distance(a, b), 6).alias("distance"), F.round(F.get(s.normalize(a), F.lit(0)), 6).alias("unit"), F.round(F.get(s.scale(a, 2.5), F.lit(1)), 6).alias("scaled"), F.round(F.get(s.add(a, b), F.lit(2)), 6).alias("added"), F.round(F.get(s.subtract(a, b), F.lit(0)), 6).alias("less"), *[F.round(F.get(cross, F.lit(i)), 6).alias(f"c{c}") for i, c in enumerate("xyz")])


# --- small matrices: 2 x 2 from the vectors, made well-conditioned by their diagonal ---

_M = "m AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + 2 AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) + 3 AS d, CAST(embedding[5] AS DOUBLE) AS p, CAST(embedding[6] AS DOUBLE) AS q FROM embeddings)"


def _matrices(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 6).alias("e"))


def _square(r: dict) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d, p, q = r["e"]
    return linalg.matrix(2, 2, [a + 2, b, c, d + 3]), linalg.matrix(2, 1, [p, q])


@query(f"WITH {_M} SELECT vec_id, round(a * d - b * c, 6) AS det, round(d / (a * d - b * c), 6) AS i00, round(-b / (a * d - b * c), 6) AS i01, round((d * p - b * q) / (a * d - b * c), 6) AS x, round((a * q - c * p) / (a * d - b * c), 6) AS y FROM m")
def matrix_solve(spark, sf_dir):
    def f(r):
        m, v = _square(r)
        p, low, up = linalg.plu(m)
        inv, x = linalg.inverse(m), linalg.solve(m, v)
        det = float(np.linalg.det(p) * np.prod(np.diag(up)))
        return {"vec_id": r["vec_id"], "det": round(det, 6), "i00": round(float(inv[0, 0]), 6), "i01": round(float(inv[0, 1]), 6), "x": round(float(x[0, 0]), 6), "y": round(float(x[1, 0]), 6)}

    return mapped(_matrices(spark, sf_dir), f, "vec_id bigint, det double, i00 double, i01 double, x double, y double")


@query(f"WITH {_M}, t AS (SELECT vec_id, a*a + c*c AS e, a*b + c*d AS f, b*b + d*d AS g, p, q FROM m) SELECT vec_id, round(sqrt(e), 6) AS u00, round(f / sqrt(e), 6) AS u01, round(sqrt(g - f * f / e), 6) AS u11, round((g * p - f * q) / (e * g - f * f), 6) AS x, round((e * q - f * p) / (e * g - f * f), 6) AS y FROM t")
def matrix_cholesky(spark, sf_dir):
    def f(r):
        m, v = _square(r)
        u = linalg.cholesky(m.T @ m)
        x = linalg.cholesky_solve(u, v)
        return {"vec_id": r["vec_id"], "u00": round(float(u[0, 0]), 6), "u01": round(float(u[0, 1]), 6), "u11": round(float(u[1, 1]), 6), "x": round(float(x[0, 0]), 6), "y": round(float(x[1, 0]), 6)}

    return mapped(_matrices(spark, sf_dir), f, "vec_id bigint, u00 double, u01 double, u11 double, x double, y double")


@query(f"WITH {_M}, t AS (SELECT vec_id, a*a + b*b + c*c + d*d AS n, abs(a * d - b * c) AS det FROM m) SELECT vec_id, round(sqrt((n + sqrt(greatest(n * n - 4 * det * det, 0))) / 2), 6) AS s0, round(sqrt((n - sqrt(greatest(n * n - 4 * det * det, 0))) / 2), 6) AS s1 FROM t")
def matrix_svd(spark, sf_dir):
    def f(r):
        _, w, _ = linalg.svd(_square(r)[0])
        return {"vec_id": r["vec_id"], "s0": round(float(w[0, 0]), 6), "s1": round(float(w[1, 1]), 6)}

    return mapped(_matrices(spark, sf_dir), f, "vec_id bigint, s0 double, s1 double")


@query(f"WITH {_M}, t AS (SELECT vec_id, a * d - b * c AS det, a, b, c, d, 2*a*p + 2*b*q - p AS u, 2*c*p + 2*d*q - q AS v FROM m) SELECT vec_id, round((d * u - b * v) / det, 6) AS x, round((a * v - c * u) / det, 6) AS y, round(b, 6) AS turned FROM t")
def matrix_expression(spark, sf_dir):
    """M^-1 (2 M v - v) and an entry of M', in the expression language."""

    def f(r):
        m, v = _square(r)
        x = linalg.evaluate("M^-1 * (2 M * M - M)", m, m, v, v)
        return {"vec_id": r["vec_id"], "x": round(float(x[0, 0]), 6), "y": round(float(x[1, 0]), 6), "turned": round(float(linalg.evaluate("M'", m)[1, 0]), 6)}

    return mapped(_matrices(spark, sf_dir), f, "vec_id bigint, x double, y double, turned double")


@query("""WITH q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) + 1 AS w, CAST(embedding[2] AS DOUBLE) AS x, CAST(embedding[3] AS DOUBLE) AS y, CAST(embedding[4] AS DOUBLE) AS z FROM embeddings),
u AS (SELECT vec_id, w / n AS w, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(w*w + x*x + y*y + z*z) AS n FROM q))
SELECT vec_id, round(1 - 2 * (y*y + z*z), 6) AS r00, round(2 * (x*y - w*z), 6) AS r01, round(2 * (x*y + w*z), 6) AS vy, round(2 * (x*z - w*y), 6) AS vz, round(2 * acos(least(1, abs(w))), 5) AS angle, round(w*w - x*x - y*y - z*z, 6) AS twice FROM u""")
def quaternions(spark, sf_dir):
    def f(r):
        q = np.array(r["e"][:4]) + [1, 0, 0, 0]
        u = q / np.linalg.norm(q)
        m, v = linalg.quat_to_matrix(q), linalg.quat_rotate(q, np.array([1.0, 0, 0]))
        angle, axis = linalg.quat_to_angle_axis(u if u[0] >= 0 else -u)
        back = linalg.quat_from_matrix(linalg.quat_to_matrix(linalg.quat_from_angle_axis(angle, axis)))
        return {"vec_id": r["vec_id"], "r00": round(float(m[0, 0]), 6), "r01": round(float(m[0, 1]), 6), "vy": round(float(v[1]), 6), "vz": round(float(v[2]), 6), "angle": round(float(2 * np.arccos(min(1.0, abs(back[0])))), 5), "twice": round(float(linalg.quat_multiply(u, u)[0]), 6)}

    return mapped(_matrices(spark, sf_dir), f, "vec_id bigint, r00 double, r01 double, vy double, vz double, angle double, twice double")


@query("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS t, CAST(embedding[4] AS DOUBLE) AS u, CAST(embedding[5] AS DOUBLE) AS v, CAST(embedding[6] AS DOUBLE) AS w FROM embeddings)
SELECT vec_id, round(x + cos(t) * u - sin(t) * v, 6) AS x, round(y + sin(t) * u + cos(t) * v, 6) AS y, round(t + w, 6) AS t, round(-cos(t) * x - sin(t) * y, 6) AS ix, round(sin(t) * x - cos(t) * y, 6) AS iy FROM p""")
def planar_motions(spark, sf_dir):
    def f(r):
        a, b = np.array(r["e"][:3]), np.array(r["e"][3:6])
        m, i = linalg.xyt_multiply(a, b), linalg.xyt_inverse(a)
        return {"vec_id": r["vec_id"], "x": round(float(m[0]), 6), "y": round(float(m[1]), 6), "t": round(float(m[2]), 6), "ix": round(float(i[0]), 6), "iy": round(float(i[1]), 6)}

    return mapped(_matrices(spark, sf_dir), f, "vec_id bigint, x double, y double, t double, ix double, iy double")


# --- quads: homographies, projections, overlaps ---

_UNIT = """h AS (SELECT k, x1, y1, x2, y2, x4, y4, ((x1-x2+x3-x4)*(y4-y3) - (x4-x3)*(y1-y2+y3-y4)) / ((x2-x3)*(y4-y3) - (x4-x3)*(y2-y3)) AS g,
  ((x2-x3)*(y1-y2+y3-y4) - (x1-x2+x3-x4)*(y2-y3)) / ((x2-x3)*(y4-y3) - (x4-x3)*(y2-y3)) AS h FROM q)"""


def _homographies(spark, sf_dir, f: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    def run(r):
        h = quads.homography(np.array([(p["x"], p["y"]) for p in r["p"]]))
        return {"k": r["k"]} | {c: round(float(v), 5) + 0.0 for c, v in f(h).items()}

    return mapped(polygons(spark, sf_dir), run, "k bigint, " + schema)


@query(f"""WITH {_POLY}, {_UNIT},
t AS (SELECT k, (x2 - x1 + g * x2) / 2 AS a, (x4 - x1 + h * x4) / 2 AS b, x1 + (x2 - x1 + g * x2 + x4 - x1 + h * x4) / 2 AS c, (y2 - y1 + g * y2) / 2 AS d, (y4 - y1 + h * y4) / 2 AS e, y1 + (y2 - y1 + g * y2 + y4 - y1 + h * y4) / 2 AS f, g / 2 AS g, h / 2 AS h, 1 + (g + h) / 2 AS i FROM h)
SELECT k, round(a / i, 5) + 0 AS h00, round(b / i, 5) + 0 AS h01, round(c / i, 5) + 0 AS h02, round(d / i, 5) + 0 AS h10, round(e / i, 5) + 0 AS h11, round(f / i, 5) + 0 AS h12, round(g / i, 5) + 0 AS h20, round(h / i, 5) + 0 AS h21 FROM t""")
def homography4(spark, sf_dir):
    """The map of the square with corners (-1, -1) to (1, 1) to each part's quad."""
    names = ["h00", "h01", "h02", "h10", "h11", "h12", "h20", "h21"]
    return _homographies(spark, sf_dir, lambda h: dict(zip(names, h.ravel())), ", ".join(f"{n} double" for n in names))


@query(f"""WITH {_POLY}, {_UNIT}, spot(u, v, name) AS (VALUES (0.5, 0.5, 'c'), (0.75, 0.25, 'p')),
t AS (SELECT k, name, ((x2 - x1 + g * x2) * u + (x4 - x1 + h * x4) * v + x1) / (g * u + h * v + 1) AS x, ((y2 - y1 + g * y2) * u + (y4 - y1 + h * y4) * v + y1) / (g * u + h * v + 1) AS y FROM h, spot)
SELECT k, round(max(x) FILTER (WHERE name = 'c'), 5) + 0 AS cx, round(max(y) FILTER (WHERE name = 'c'), 5) + 0 AS cy, round(max(x) FILTER (WHERE name = 'p'), 5) + 0 AS px, round(max(y) FILTER (WHERE name = 'p'), 5) + 0 AS py FROM t GROUP BY k""")
def project_points(spark, sf_dir):
    """The centre of the square, and the point (0.5, -0.5), in each quad."""

    def f(h):
        (cx, px), (cy, py) = quads.project(h, [0, 0.5], [0, -0.5])
        return {"cx": cx, "cy": cy, "px": px, "py": py}

    return _homographies(spark, sf_dir, f, "cx double, cy double, px double, py double")


def _inside_sql(p: str, x: str, y: str) -> str:
    def side(i):
        a, b = (f"{p}.x{i}", f"{p}.y{i}"), (f"{p}.x{i % 4 + 1}", f"{p}.y{i % 4 + 1}")
        return f"CASE WHEN ({a[1]} > {y}) <> ({b[1]} > {y}) AND {x} < ({b[0]} - {a[0]}) * ({y} - {a[1]}) / nullif({b[1]} - {a[1]}, 0) + {a[0]} THEN 1 ELSE 0 END"

    return f"(({' + '.join(side(i) for i in range(1, 5))}) % 2 = 1)"


_MEET = " OR ".join(_crosses(i, j) for i in range(1, 5) for j in range(1, 5))
_MEAN = {n: (f"(({n}.x1 + {n}.x2 + {n}.x3) / 3)", f"(({n}.y1 + {n}.y2 + {n}.y3) / 3)") for n in "ab"}
_OVER = f"({_MEET}) OR {_inside_sql('a', *_MEAN['b'])} OR {_inside_sql('b', *_MEAN['a'])}"
ORACLES["polygon_overlaps"] = f"WITH {_POLY} SELECT a.k, {_OVER} AS overlaps, NOT ({_MEET}) AND {_inside_sql('a', 'b.x1', 'b.y1')} AS contains FROM q a JOIN q b ON b.k = a.k + 1"


@query(f"""WITH {_POLY}, d AS (SELECT *, k % 50 AS image, k % 4 AS hamming, k * 31 % 997 / CAST(10 AS DOUBLE) AS margin FROM q),
rival AS (SELECT a.k, min(CASE WHEN b.hamming < a.hamming OR (b.hamming = a.hamming AND b.margin > a.margin) THEN 1 END) AS beaten FROM d a JOIN d b ON a.image = b.image AND a.k <> b.k AND ({_OVER}) GROUP BY a.k)
SELECT image, count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM rival WHERE rival.k = d.k AND beaten = 1) GROUP BY image""")
def unbeaten_detections(spark, sf_dir):
    """How many detections of each image no overlapping one beats: fewer wrong bits, then the larger margin."""
    d = polygons(spark, sf_dir).select("k", "p", (F.col("k") % 50).alias("image"), (F.col("k") % 4).alias("hamming"), (F.col("k") * 31 % 997 / F.lit(10.0)).alias("margin"))
    left = compare.unbeaten(d, "image", "p", F.struct("hamming", (-F.col("margin")).alias("margin")))
    return left.groupBy("image").agg(F.count(F.lit(1)).alias("n"))


_TWINS = "SELECT p_partkey AS k, CAST(p_partkey % 3 AS INTEGER) AS hamming, p_partkey % 7 + 0.5 AS margin, p_partkey % 2 = 0 AS apart FROM part"


@query(f"SELECT k, CAST(n AS BIGINT) AS n, CAST(kept AS BIGINT) AS kept FROM (SELECT k, CASE WHEN apart THEN 2 ELSE 1 END AS n, CASE WHEN apart THEN hamming + 1 ELSE CASE WHEN hamming = 0 THEN 0 ELSE 1 END END AS kept FROM ({_TWINS})) t")
def reconcile_overlaps(spark, sf_dir):
    """Two detections of one identity for each part, on one place or apart: with k % 3 wrong bits, and with one."""

    def f(r):
        size = 10.0
        at = lambda x: [(x, 0.0), (x + size, 0.0), (x + size, size), (x, size)]
        shift = 100.0 if r["apart"] else 2.0
        found = [{"family": "f", "id": 1, "hamming": r["hamming"], "decision_margin": r["margin"], "corners": at(0.0)}, {"family": "f", "id": 1, "hamming": 1, "decision_margin": 0.25, "corners": at(shift)}]
        kept = plan.reconcile(found)
        return {"k": r["k"], "n": len(kept), "kept": sum(x["hamming"] for x in kept)}

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 3).cast("int").alias("hamming"), (F.col("p_partkey") % 7 + 0.5).alias("margin"), (F.col("p_partkey") % 2 == 0).alias("apart"))
    return mapped(p, f, "k bigint, n bigint, kept bigint")


@query(f"""WITH {_POLY}, pt AS (SELECT *, CAST(k * 3 % 50 AS DOUBLE) + 0.3 AS u, CAST(k * 11 % 50 AS DOUBLE) + 0.3 AS v FROM q),
side AS (SELECT k, u, v, unnest([{{'ax': x1, 'ay': y1, 'bx': x2, 'by': y2}}, {{'ax': x2, 'ay': y2, 'bx': x3, 'by': y3}}, {{'ax': x3, 'ay': y3, 'bx': x4, 'by': y4}}, {{'ax': x4, 'ay': y4, 'bx': x1, 'by': y1}}]) AS s FROM pt),
foot AS (SELECT k, u, v, s, greatest(0, least(1, ((u - s.ax) * (s.bx - s.ax) + (v - s.ay) * (s.by - s.ay)) / ((s.bx - s.ax) * (s.bx - s.ax) + (s.by - s.ay) * (s.by - s.ay)))) AS t FROM side),
near AS (SELECT k, min(sqrt((s.ax + t * (s.bx - s.ax) - u) * (s.ax + t * (s.bx - s.ax) - u) + (s.ay + t * (s.by - s.ay) - v) * (s.ay + t * (s.by - s.ay) - v))) AS d,
  list_sort(list(s.ax + (s.bx - s.ax) * (v - s.ay) / (s.by - s.ay)) FILTER (WHERE (s.ay > v) <> (s.by > v))) AS xs FROM foot GROUP BY k)
SELECT k, round(d, 5) AS distance, CAST(coalesce(len(xs), 0) AS INTEGER) AS n_crossings, round(xs[1], 5) AS first FROM near""")
def polygon_boundary(spark, sf_dir):
    """How far each quad's boundary is from a point, and where it crosses the point's row."""
    at = F.struct((F.col("k") * 3 % 50 + 0.3).alias("x"), (F.col("k") * 11 % 50 + 0.3).alias("y"))
    p = polygons(spark, sf_dir).select("k", "p", at.alias("at"))
    xs = g.row_crossings(F.col("p"), F.col("at.y"))
    return p.select("k", F.round(g.distance(g.closest_on_boundary(F.col("p"), F.col("at")), F.col("at")), 5).alias("distance"), F.size(xs).alias("n_crossings"), F.round(F.get(xs, F.lit(0)), 5).alias("first"))


# --- image files: the matrix written as a file of each kind and read again ---


def _bytes_of(spark, sf_dir, suffix: str) -> DataFrame:
    files = readers.encode_images(pixels.pack(matrix(spark, sf_dir)), suffix)
    return readers.decode_files(files.select(F.concat("image_id", F.lit(f".{suffix}")).alias("path"), "content"))


def _through(suffix: str) -> None:
    def run(spark, sf_dir):
        return pixels.unpack(_bytes_of(spark, sf_dir, suffix)).select("y", "x", "v")

    run.__name__ = f"{suffix}_round_trip"
    run.__doc__ = f"The matrix image as a {suffix} file, read again."
    query(f"WITH {PX} SELECT y, x, v FROM px")(run)


for _suffix in ("pgm", "png", "npy", "pam"):
    _through(_suffix)


_RGB = f"""{PX}, rgb AS (SELECT y, x, v AS r, 255 - v AS g, (v * 7 + x) % 256 AS b FROM px)"""


def _color(r: dict) -> np.ndarray:
    v = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]).astype(np.int64)
    return np.stack([v, 255 - v, (v * 7 + np.arange(r["width"])) % 256], axis=2).astype(np.uint8)


@query(f"WITH {_RGB} SELECT CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, count(*) AS n FROM rgb")
def color_round_trip(spark, sf_dir):
    """Sums of the channels of a colour image written as PPM, PAM and PNG and read again; all three must agree."""

    def f(r):
        a = _color(r)
        read = [codecs.decode_pnm(codecs.encode_pnm(a)), codecs.decode_pam(codecs.encode_pam(codecs.with_alpha(a)))[:, :, :3], codecs.decode_png(codecs.encode_png(a))]
        if not all((x == a).all() for x in read):
            raise ValueError("a file was read otherwise than it was written")
        return dict(zip("rgb", read[0].astype(np.int64).sum(axis=(0, 1)).tolist())) | {"n": a.shape[0] * a.shape[1]}

    return mapped(pixels.pack(matrix(spark, sf_dir)), f, "r bigint, g bigint, b bigint, n bigint")


# --- pixels ---


_TURN = 0.5
_COS, _SIN = f"CAST({math.cos(_TURN)!r} AS DOUBLE)", f"CAST({math.sin(_TURN)!r} AS DOUBLE)"


@query(f"""WITH {PX}, big AS (SELECT w, h, CAST(ceil(abs(w * {_COS}) + abs(h * {_SIN})) AS INTEGER) AS ow, CAST(ceil(abs(w * {_SIN}) + abs(h * {_COS})) AS INTEGER) AS oh FROM dim),
grid AS (SELECT w, h, oy, ox, ox + CAST(0.5 AS DOUBLE) - ow / 2 AS dx, oy + CAST(0.5 AS DOUBLE) - oh / 2 AS dy FROM big, range(0, 4000) a(oy), range(0, 4000) b(ox) WHERE oy < oh AND ox < ow),
spot AS (SELECT oy, ox, CAST(floor(dx * {_COS} + dy * {_SIN} + w / 2) AS INTEGER) AS x, CAST(floor(-dx * {_SIN} + dy * {_COS} + h / 2) AS INTEGER) AS y FROM grid)
SELECT CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, coalesce(v, 7) AS v FROM spot LEFT JOIN px USING (y, x)""")
def rotate_image(spark, sf_dir):
    """Turned by half a radian into a larger image."""
    return pixels.rotate(matrix(spark, sf_dir), _TURN, 7).select("y", "x", "v")


@query(f"""WITH {PX}, v AS (SELECT y, x, v, row_number() OVER (PARTITION BY y ORDER BY v DESC, x) AS r FROM px) SELECT y, x, v FROM v WHERE r <= 5""")
def brightest_pixels(spark, sf_dir):
    return decode.first_rows(matrix(spark, sf_dir).select("y", "x", "v"), ["y"], [F.desc("v"), "x"], 5).select("y", "x", "v")


def shapes(spark, sf_dir) -> DataFrame:
    """A line for each part, in an image of 120 x 90."""
    k = "p_partkey"
    return table(spark, sf_dir, "part").selectExpr(f"{k} AS k", f"CAST({k} * 7 % 130 AS DOUBLE) - 5 AS x0", f"CAST({k} * 13 % 100 AS DOUBLE) - 5 AS y0", f"CAST({k} * 17 % 130 AS DOUBLE) AS x1", f"CAST({k} * 29 % 100 AS DOUBLE) AS y1", f"CAST({k} % 3 AS DOUBLE) AS r0", f"CAST({k} % 3 + {k} % 5 + 1 AS DOUBLE) AS r1")


_SHAPES = "s AS (SELECT p_partkey AS k, CAST(p_partkey * 7 % 130 AS DOUBLE) - 5 AS x0, CAST(p_partkey * 13 % 100 AS DOUBLE) - 5 AS y0, CAST(p_partkey * 17 % 130 AS DOUBLE) AS x1, CAST(p_partkey * 29 % 100 AS DOUBLE) AS y1, CAST(p_partkey % 3 AS DOUBLE) AS r0, CAST(p_partkey % 3 + p_partkey % 5 + 1 AS DOUBLE) AS r1 FROM part)"


@query(f"""WITH {_SHAPES}, d AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS d FROM s), t AS (SELECT *, unnest(range(0, CAST(floor(2 * d) AS BIGINT) + 1)) AS i FROM d WHERE d > 0)
SELECT DISTINCT k, CAST(trunc(y1 + (y0 - y1) * (i * CAST(0.5 AS DOUBLE) / d)) AS INTEGER) AS y, CAST(trunc(x1 + (x0 - x1) * (i * CAST(0.5 AS DOUBLE) / d)) AS INTEGER) AS x FROM t WHERE trunc(x1 + (x0 - x1) * (i * CAST(0.5 AS DOUBLE) / d)) BETWEEN 0 AND 119 AND trunc(y1 + (y0 - y1) * (i * CAST(0.5 AS DOUBLE) / d)) BETWEEN 0 AND 89""")
def draw_lines(spark, sf_dir):
    return drawing.line_pixels(shapes(spark, sf_dir), ["k"], 120, 90)


@query(f"WITH {_SHAPES} SELECT k, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM s, range(0, 90) a(y), range(0, 120) b(x) WHERE (x - x0) * (x - x0) + (y - y0) * (y - y0) BETWEEN r0 * r0 AND r1 * r1")
def draw_rings(spark, sf_dir):
    return drawing.ring_pixels(shapes(spark, sf_dir), ["k"], 120, 90)


_LUT, _LUT_SCALE = (255, 200, 150, 90, 40, 10), 0.5


@query(f"""WITH {_SHAPES}, d AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS d FROM s WHERE k <= 40), p AS (SELECT y, x, x0, y0, x1, y1, d, greatest(0, least(d, ((x + CAST(0.5 AS DOUBLE) - x0) * (x1 - x0) + (y + CAST(0.5 AS DOUBLE) - y0) * (y1 - y0)) / d)) AS t FROM d, range(0, 90) a(y), range(0, 120) b(x) WHERE d > 0),
i AS (SELECT y, x, CAST(floor((pow(x + CAST(0.5 AS DOUBLE) - x0 - t * (x1 - x0) / d, 2) + pow(y + CAST(0.5 AS DOUBLE) - y0 - t * (y1 - y0) / d, 2)) * {_LUT_SCALE}) AS INTEGER) AS i FROM p)
SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, max([{', '.join(map(str, _LUT))}][i + 1]) AS v FROM i WHERE i < {len(_LUT)} GROUP BY y, x""")
def line_table(spark, sf_dir):
    """The first forty lines drawn into one image, the brightest value at each pixel."""
    image = pixels.synthetic(spark, "zero", 120, 90)
    marks = drawing.line_values(shapes(spark, sf_dir).where("k <= 40").withColumn("image_id", F.lit("zero")), ["image_id"], list(_LUT), _LUT_SCALE, 120, 90)
    return drawing.draw(image, marks, F.col("v"), True).where("v > 0").select("y", "x", "v")


_CHANNELS = f"{PX}, rgb AS (SELECT c, y, x, CASE c WHEN 'r' THEN v WHEN 'g' THEN 255 - v ELSE (v * 7 + x) % 256 END AS v FROM px, (VALUES ('r'), ('g'), ('b')) k(c))"


@query(f"WITH {_CHANNELS}, {_conv_sql('rgb', 'x', 'c, y', 'w', 'a', ', c')}, {_conv_sql('a', 'y', 'c, x', 'h', 'b', ', c')} SELECT c, y, x, CAST(v AS INTEGER) AS v FROM b")
def color_blur(spark, sf_dir):
    """A colour image is one image for each channel."""
    m = matrix(spark, sf_dir)
    values = {"r": F.col("v"), "g": 255 - F.col("v"), "b": (F.col("v") * 7 + F.col("x")) % 256}
    rgb = None
    for c, v in values.items():
        one = m.select(F.lit(c).alias("image_id"), "w", "h", "y", "x", v.alias("v"))
        rgb = one if rgb is None else rgb.unionByName(one)
    return pixels.gaussian_blur(rgb, SIGMA).select(F.col("image_id").alias("c"), "y", "x", "v")


_ROOTS = "r AS (SELECT p_partkey AS k, CAST(p_partkey % 7 - 10 AS DOUBLE) AS a, CAST(p_partkey % 11 AS DOUBLE) / 10 AS b, CAST(p_partkey % 13 + 2 AS DOUBLE) AS c FROM part)"


@query(f"WITH {_ROOTS} SELECT k, 3 AS n, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM r")
def polynomial_roots(spark, sf_dir):
    """The three roots of a cubic made from them."""

    def run(batches):
        for batch in batches:
            a, b, c = (batch.column(k).to_numpy() for k in (1, 2, 3))
            found = polynomial.roots_of(np.stack([-a * b * c, a * b + b * c + a * c, -(a + b + c), np.ones(len(a))], axis=1))
            rounded = [[round(x, 4) + 0.0 for x in r] + [None] * (3 - len(r)) for r in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in found], pa.int64()), *[pa.array([r[k] for r in rounded], pa.float64()) for k in range(3)]], names=["k", "n", "a", "b", "c"])

    rows = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS k", "CAST(p_partkey % 7 - 10 AS DOUBLE) AS a", "CAST(p_partkey % 11 AS DOUBLE) / 10 AS b", "CAST(p_partkey % 13 + 2 AS DOUBLE) AS c")
    return rows.mapInArrow(run, "k bigint, n bigint, a double, b double, c double").withColumn("n", F.col("n").cast("int"))


@query("SELECT event_type, event_id, CAST(r AS INTEGER) AS popped FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def heap_pops(spark, sf_dir):
    """What a heap of each type gives first, second and third: the largest value, without sorting the rest."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    top = decode.first_rows(e.select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), "event_id"], 3)
    return top.select("event_type", "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).alias("popped"))


@query("SELECT k, CAST(row_number() OVER (PARTITION BY id ORDER BY rx, ry, k) AS INTEGER) AS place FROM (SELECT p_partkey AS k, p_size AS id, round(p_retailprice / 10, 0) AS rx, round(p_partkey / 100, 0) AS ry FROM part)")
def tolerant_order(spark, sf_dir):
    """Rows of each id in the order of coordinates that count as equal within a rounding."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size AS id", "round(p_retailprice / 10, 0) AS rx", "round(p_partkey / 100, 0) AS ry")
    return p.select("k", F.row_number().over(Window.partitionBy("id").orderBy("rx", "ry", "k")).alias("place"))


@query(f"WITH {PX} SELECT count(*) AS pixels, round(count(*) / 1e6, 6) AS megapixels, count(*) * 3 AS elements, count(*) * 12 AS bytes FROM px")
def size_accounting(spark, sf_dir):
    """Sizes of the matrix image with three channels of 32 bits."""
    n = F.sum(F.col("width").cast("bigint") * F.col("height"))
    return pixels.pack(matrix(spark, sf_dir)).agg(n.alias("pixels"), F.round(n / 1e6, 6).alias("megapixels"), (n * 3).alias("elements"), (n * 12).alias("bytes"))


@query(f"SELECT image_id, CAST(seq AS INTEGER) AS seq, name FROM (VALUES {_values((f'tag16h5-{i}-{r}',) for i in range(30) for r in range(4))}) t(image_id), (VALUES {_values(enumerate(plan.STEPS))}) s(seq, name)")
def stage_stamps(spark, sf_dir):
    """The steps that each scene went through, in order of their time."""
    stamps = plan.stage_stamps(synthetic.scenes(spark, "tag16h5", 10, 30), DetectorConfig(quad_decimate=1.0))
    by_time = Window.partitionBy("image_id").orderBy("utime", "seq")
    return stamps.select("image_id", (F.row_number().over(by_time) - 1).alias("seq"), "name")
