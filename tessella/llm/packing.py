"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces and gaps (the room left in open sequences) are tables, range-sorted by size and written; a size that many rows have spreads
over several ranges. Rounds take bands of lengths from the longest. A round

1. sweeps pieces and gaps from the largest: a piece takes its successor, the smallest free gap that holds it. Gaps no larger than
   the round's longest piece open levels like brackets, the next piece closes the last one open; so a piece and its gap are
   neighbours among the few rows of their level, which are matched by a window over levels.
2. resolves conflicts by rank: pieces that find no such gap go by rank to the slots of the larger gaps, which hold any piece of the
   round, one or more, the smallest first; the rest open sequences by rank.
3. writes the placed pieces, updates the gaps and sorts them again.

A round is repeated with what is left of its band, where opening sequences for all of it at once would waste room. There are at most
``ROUNDS`` rounds whatever the rows, and in each the driver holds sums by (range, size): at most as many as there are ranges and sizes together.
Everything else stays in the tables. The result has as many sequences as sequential best-fit decreasing, or a few more in thousands.

A null text is an empty one: its single token is the end id. A very long text is cut into pieces of the capacity, each a sequence of its own, but for
the last. Rows that repeat a doc_id, or have none, are packed each; ties of length go by a hash of (doc_id, piece), and rows equal in all have
places in no fixed order. An empty table gives no rows. Other columns of the table are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, ease, keyed, materialize, scratch, table, text_of
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Rows in one range of a sorted table, about.
RANGE = 50_000
#: Sweeps of one band before it opens sequences for all that is left; share of sequences that may be opened beyond the least possible.
REPEATS, SPARE = 4, 0.01
#: Most rounds there can be at the default capacity: bands times repeats.
ROUNDS = 56


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, end each with ``end_id``, and cut those longer than ``capacity``."""

    def cut(batches):
        enc = encoder(path)
        for batch, texts in blocks(batches):
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.encode_bytes(texts.to_pylist())):
                ids = np.append(np.frombuffer(raw, np.uint16), np.uint16(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    rows.append((doc_id, k, a, len(part), zlib.crc32(part.tobytes()), part.tobytes() if with_ids else None))
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)][: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    docs = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    return docs.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint" + ", ids binary" * with_ids)


def bands(capacity: int) -> list[tuple[int, int]]:
    """(longest, next band's longest): up to the sixth part of the capacity by how many fit a sequence, then by a factor."""
    cuts = [capacity // j for j in range(1, 7)]
    while cuts[-1] > 1:
        cuts.append(int(cuts[-1] * (0.6 if cuts[-1] > capacity // 32 else 0.4)))
    return list(pairwise([*dict.fromkeys(c for c in cuts if c > 0), 0]))


class Sorted:
    """Rows range-sorted by ``size``, as a written table in which _id tells range and place, and the sums of each (range, size) above 0."""

    def __init__(self, rows: DataFrame, n_rows: int, order: list[Column], name: str):
        parts = 1 + n_rows // RANGE
        rows = rows.repartitionByRange(parts, "size", *order) if parts > 1 else rows.coalesce(1)
        rows = rows.sortWithinPartitions("size", *order).withColumn("_id", F.monotonically_increasing_id())
        self.path = scratch(rows.sparkSession, name)
        rows.write.parquet(self.path)
        ease(rows.sparkSession)
        self.rows = rows.sparkSession.read.schema(rows.schema).parquet(self.path)
        sums = self.rows.where("size > 0").groupBy(F.shiftright("_id", 33).alias("part"), "size").agg(F.count(F.lit(1)), F.min("_id")).collect()
        self.counts: dict[int, int] = {}
        self.offsets: list[tuple[int, int, int]] = []
        for part, size, n, least in sorted(tuple(r) for r in sums):
            self.offsets.append((part, size, self.counts.get(size, 0) - least))
            self.counts[size] = self.counts.get(size, 0) + n

    def told(self, by_size: dict[int, tuple], names: tuple[str, ...], how: str) -> DataFrame:
        """The rows with _rank, their place among those of their size, and what ``by_size`` says of that; it is broadcast, a row for each (range, size) at most."""
        said = [(part, size, offset, *by_size[size]) for part, size, offset in self.offsets if size in by_size]
        columns = ("_part", "_size", "_offset", *names)
        said = self.rows.sparkSession.createDataFrame(pa.table({n: pa.array([x[k] for x in said], pa.int64()) for k, n in enumerate(columns)}))
        rows = self.rows.where(F.col("size").between(min(by_size), max(by_size))) if how == "inner" else self.rows.where("size > 0")  # ranges are sorted, so others aren't read
        here = (F.shiftright("_id", 33) == F.col("_part")) & (F.col("size") == F.col("_size"))
        return rows.join(F.broadcast(said), here, how).selectExpr("*", "_id + _offset AS _rank")


class Sweep:
    """The sums of one round: where each size's pieces and gaps begin in levels, slots and new sequences."""

    def __init__(self, left: dict[int, tuple[int, int]], gaps: dict[int, int], capacity: int, last: bool):
        """``left``: for each length of the band the first rank that is not placed and the number of pieces; ``gaps``: how many there are of each size."""
        self.top, least = max(left), min(left)
        self.each = capacity // self.top
        depth = waiting = 0
        self.levels: list[tuple[int, int]] = []  # gap size, level before its first
        self.pieces: list[tuple[int, int, int, int, int]] = []  # length, first rank, matched, level of the first, number waiting before
        need: list[tuple[int, int]] = []
        for size in sorted({*left, *(g for g in gaps if least <= g < self.top)}, reverse=True):
            if least <= size < self.top and size in gaps:
                self.levels.append((size, depth))
                depth += gaps[size]
            if size in left:
                first, end = left[size]
                matched = min(end - first, depth)
                self.pieces.append((size, first, matched, depth, waiting))
                depth -= matched
                waiting += end - first - matched
                need.append((size, end - first - matched))
        self.slots: list[tuple[int, int, int]] = []  # gap size, pieces that one holds, first slot
        slots = 0
        for size in sorted(g for g in gaps if g >= self.top):
            if slots < waiting:
                self.slots.append((size, size // self.top, slots))
                slots += gaps[size] * (size // self.top)
        self.in_slots = min(slots, waiting)
        self.matched = sum(x[2] for x in self.pieces)
        # those that wait beyond the slots open sequences
        skip, tokens = self.in_slots, 0
        for size, n in need:
            tokens += size * max(0, n - skip)
            skip = max(0, skip - n)
        rest = waiting - self.in_slots
        full, exact = -(-rest // self.each), -(-tokens // capacity)
        whole = last or capacity // least == self.each or full <= exact * (1 + SPARE) + 1
        self.opened = full if whole else exact
        self.taken = min(waiting, self.in_slots + self.opened * self.each)
        self.left = {}
        for size, first, matched, _, before in self.pieces:
            begin = first + matched + max(0, min(left[size][1] - first - matched, self.taken - before))
            if begin < left[size][1]:
                self.left[size] = (begin, left[size][1])


def _round(pieces_: Sorted, gaps: Sorted | None, s: Sweep, sequences: int, capacity: int, names: list[str], kind: str) -> DataFrame:
    """Pieces that find a place: ``names`` as _row (of type ``kind``), sequence_id and offset, with size -1; and all gaps, without a _row: sequence_id and the size that is left."""
    spark = pieces_.rows.sparkSession
    # a gap's key is its level, negative, or each of its slots
    slots = "_key[0] <= _key[1] THEN sequence(_key[0], _key[1])"
    room = spark.range(s.opened).selectExpr(f"{sequences} + id AS sequence_id", f"{capacity}L AS size", f"array({s.in_slots} + id * {s.each}, least({s.in_slots} + (id + 1) * {s.each}, {s.taken}L) - 1) AS _key", "false AS _level")
    if gaps:
        said = {size: (None, hold, slot, s.in_slots) for size, hold, slot in s.slots} | {size: (base, None, None, None) for size, base in s.levels}
        old = gaps.told(said, ("_base", "_hold", "_first", "_end"), "left")
        room = room.unionAll(old.selectExpr("sequence_id", "size", "CASE WHEN _base IS NULL THEN array(_first + _rank * _hold, least(_first + (_rank + 1) * _hold, _end) - 1) ELSE array(-(_base + _rank + 1)) END AS _key", "_base IS NOT NULL AS _level"))
    told = {size: (first, matched, level, before, s.taken) for size, first, matched, level, before in s.pieces}
    own = pieces_.told(told, ("_first", "_matched", "_level", "_before", "_end"), "inner").where("_rank >= _first")
    row = ", ".join(f"`{c}`" for c in names)
    own = own.selectExpr("_rank - _first + if(_rank - _first < _matched, -_level, _before - _matched) AS _key", "size", "CAST(NULL AS struct<sequence_id:bigint,gap:bigint>) AS _place", f"struct({row}) AS _row", "_end").where("_key < _end").drop("_end")
    rows = room.selectExpr(f"explode(CASE WHEN _level THEN _key WHEN {slots} END) AS _key", "size", "struct(sequence_id, size AS gap) AS _place", f"CAST(NULL AS {kind}) AS _row").unionAll(own)
    placed = rows.selectExpr("_key", "size", "_row", "lag(_place) OVER (PARTITION BY _key ORDER BY size DESC, _row IS NOT NULL) AS _place").where("_row IS NOT NULL")
    # in each sequence the round's pieces by rank, and the gap itself after them
    left = room.selectExpr("sequence_id", "size AS gap", f"{1 << 62}L AS _key", "0L AS size", f"CAST(NULL AS {kind}) AS _row")
    both = placed.selectExpr("_place.sequence_id", "_place.gap", "_key", "size", "_row").unionAll(left)
    both = both.selectExpr("*", "coalesce(sum(size) OVER (PARTITION BY sequence_id ORDER BY _key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _used")
    return both.selectExpr("_row", "sequence_id", f"{capacity} - gap + _used AS offset", "if(_row IS NULL, gap - _used, -1L) AS size")


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with ``length`` (1 to capacity), doc_id and piece, in bulk-synchronous rounds."""
    spark, names, kind = lengths.sparkSession, lengths.columns, lengths.schema.simpleString()
    s = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("a"), F.max("length").alias("b")).first()
    if not s.n:
        return lengths.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    if not 1 <= s.a <= s.b <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    whole = Sorted(lengths.withColumn("size", F.col("length").cast("bigint")), s.n, [F.xxhash64("doc_id", "piece")], "sorted")
    gaps, sequences, paths = None, 0, []
    for high, low in bands(capacity):
        left = {size: (0, n) for size, n in whole.counts.items() if low < size <= high}
        repeat = 0
        while left:
            repeat += 1
            sweep = Sweep(left, gaps.counts if gaps else {}, capacity, repeat >= REPEATS)
            done = _round(whole, gaps, sweep, sequences, capacity, names, kind)
            sequences, left = sequences + sweep.opened, sweep.left
            gaps = Sorted(done, min(s.n, sequences + sum(n for size, n in whole.counts.items() if low < size <= high)), [F.xxhash64("sequence_id")], "round")
            paths.append(gaps.path)
    return spark.read.schema(gaps.rows.schema).parquet(*paths).where("_row is not null").select("_row.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and ids (little-endian unsigned 32-bit), from packed pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    packed = pack(materialize(pieces(docs, path, capacity), "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
