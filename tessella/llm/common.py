"""What the corpus operators share: durable cuts of the plan, Arrow plumbing and column guards."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised kernel handles at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Share of the driver's largest heap above which a cut of the plan has its garbage collected.
HEAP_SHARE = 0.6

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one in the warehouse, or a temporary one in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        local = sc.master.split("[")[0] == "local"
        found = tempfile.mkdtemp(prefix="tessella-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessella"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage, is compressed, serves later column pruning, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    ease(spark)
    return spark.read.schema(df.schema).parquet(path)


def ease(spark: SparkSession) -> bool:
    """Have the driver's JVM collect its garbage and shrink its heap, if that has grown over ``HEAP_SHARE`` of its limit.

    Plans, task results and events of many short jobs are garbage soon, but the heap grows for them and shrinks only when it is collected as a whole.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    grown = runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory()
    if grown:
        runtime.gc()
    return grown


def _sweep() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM has gone before us
            return


atexit.register(_sweep)


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: str = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(text), F.lit(""))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns of any name can't clash with ours."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(batches: Iterable[pa.RecordBatch], text: str | int = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches whose texts have at most ``limit`` bytes (or one row), with the texts, nulls empty. ``text``: the column's name or place."""
    for batch in batches:
        column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start), column.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start), column.slice(start)
        del batch, column
    give_back()


def give_back() -> None:
    """Free memory goes back to the system: Python workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
