"""Every registered image query against its SQL at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from tessella.operators import pixels
from tessella.plans import batteries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].astype(object).values.tolist()))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, duck, name):
    got, want = q.QUERIES[name](spark, DATA).toPandas(), duck.execute(q.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_rows(spark, name):
    assert q.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _shuffled(node) -> int:
    """Rows that the exchanges of an executed plan wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_rotation_shuffles_the_image_not_its_padding(spark):
    """A long narrow image gets a box with far more padding than pixels; two images are turned each by itself."""
    sizes = {"a": (4, 500), "b": (30, 9)}
    value = {(i, y, x): (7 * y + x) % 200 for i, (w, h) in sizes.items() for y in range(h) for x in range(w) if (y, x) != (3, 2)}
    rows = spark.createDataFrame([(i, *sizes[i], y, x, v) for (i, y, x), v in value.items()], "image_id string, w int, h int, y int, x int, v int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    turned = pixels.rotate(rows, 0.5, 255).select("image_id", "w", "h", "y", "x", "v")
    got = sorted(tuple(r) for r in turned.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    c, s, want = math.cos(0.5), math.sin(0.5), []
    for i, (w, h) in sizes.items():
        ow, oh = math.ceil(w * c + h * s), math.ceil(w * s + h * c)
        for y in range(oh):
            for x in range(ow):
                dx, dy = x + 0.5 - ow / 2, y + 0.5 - oh / 2
                want.append((i, ow, oh, y, x, value.get((i, math.floor(-dx * s + dy * c + h / 2), math.floor(dx * c + dy * s + w / 2)), 255)))
    assert got == sorted(want)
    assert _shuffled(turned._jdf.queryExecution().executedPlan()) < 5 * len(value) < len(want) / 5
