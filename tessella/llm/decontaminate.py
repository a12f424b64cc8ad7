"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``size`` consecutive words (a shorter item is one window). A text contains a window only
if it contains each of its words, so the rarest one in the corpus is enough as the window's prefix: places of texts are joined with windows on
that word alone. A match of the prefix fixes where the window would lie; length and position bounds drop
those that would leave the text, and the rest is verified word by word. The steps:

1. ``windows_of``: the distinct windows, and which items have them, as written tables.
2. Words of the windows are counted over the corpus; the least counted one of a window (then the least hash) is its prefix.
3. ``places``: one row for each text, with the places where a prefix stands next to the neighbour it has in its window, each with the words
   around it. It is written, so that rows keep their number.
4. Places and prefixes are joined by the word's hash, verified by the words, and the hits of a text are merged as intervals.

The benchmark is only ever a table: it may be of any size, and Spark broadcasts it or deals it out by its size. What goes to the executors with the code are
bit maps of words and neighbours with ``FILTER`` bits, whatever the benchmark; a wrong bit costs a row of the join and no more. A frequent word is a
prefix only of windows without a rarer one, and its places are spread by adaptive splitting of the join. Words over ``LONG`` bytes stand as their SHA-256 there.

Null or empty texts have no words and are clean. Repeated rows are judged each, and rows without a doc_id too. Items without an id are searched
like others: their windows count in n_hit and decide what is contaminated, but add no name to the items (n_items and items_sha256). Items that share an id
are one name. An empty benchmark hits nothing, an empty table gives no rows. A very long text is one row of ``places``, whose size grows with
its prefixes only. Ties of rarity go by the hash and do not change the result. Other columns are not read by ``contamination``; ``drop_contaminated``
passes them on as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, free_name, keyed, materialize, table, text_of
from .textvec import _ODD, U64, Words, mix, words

SIZE = 10
#: Bits of each map of words; they are collected, so at most as many numbers reach the driver.
FILTER = 1 << 20
#: Bytes from which on a word is told apart by its SHA-256; it begins with a capital, which no word has.
LONG = 64
#: Hit texts that may be broadcast (16 bytes each); beyond, texts are dropped by a shuffled join.
HIT = 2_000_000
#: Stands for a neighbour where a window has only one word.
ALONE = U64(0)


def _shown(word: bytes) -> str:
    return word.decode() if len(word) <= LONG else "S" + hashlib.sha256(word).hexdigest()


def _neighbour(word: np.ndarray, other: np.ndarray, side: int) -> np.ndarray:
    """The hash of a word with the one that follows it (side 1), stands before it (2) or with none (0)."""
    return mix(word * _ODD[side + 1] + other)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def windows_of(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(window, words, hashes) of each distinct window, and (window, item) of each item with an id; ``window`` is a number."""

    def cut(batches):
        for batch, texts in blocks(batches):
            w = words(texts, "alnum")
            rows = []
            for i, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                own = [_shown(w.word(k)) for k in range(a, b)]
                hashes = w.hashes[a:b].view(np.int64)
                rows += [(item, " ".join(own[k : k + size]), hashes[k : k + size]) for k in range(max(1, len(own) - size + 1) if own else 0)]
            if rows:
                items, joined, hashes = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(joined), pa.array(hashes, pa.list_(pa.int64()))], names=["item", "words", "hashes"])

    items = keyed(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), text_of().alias("text"))
    every = materialize(items.mapInArrow(cut, "item string, words string, hashes array<bigint>").distinct(), "item-windows")
    windows = materialize(every.select("words", "hashes").distinct().select(F.monotonically_increasing_id().alias("window"), "words", "hashes"), "windows")
    return windows, every.where("item is not null").join(windows.select("window", "words"), "words").select("window", "item")


def _bits(hashes: DataFrame, column: str) -> np.ndarray:
    """A map with the bits of all hashes set."""
    found = hashes.select(F.col(column).bitwiseAND(FILTER - 1).cast("int").alias("bit")).distinct().toArrow().column(0).to_numpy()
    out = np.zeros(FILTER, bool)
    out[found] = True
    return out


def _on(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return bits[(hashes & U64(len(bits) - 1)).astype(np.int64)]


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, words, prefix, at, length, side, near): each window's rarest word in ``docs``, its place, and the hash of it and its neighbour."""
    own = windows.select("window", F.posexplode("hashes").alias("at", "prefix"))
    vocabulary = _bits(own, "prefix")

    def count(batches):
        for _, texts in blocks(batches):
            h = words(texts, "alnum").hashes
            known, n = np.unique(h[_on(vocabulary, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(known), pa.array(n, pa.int64())], names=["prefix", "n"])

    counts = docs.select(text_of().alias("text")).mapInArrow(count, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    rarest = own.join(counts, "prefix", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "prefix", "at")).alias("p"))
    found = windows.join(rarest.select("window", "p.prefix", "p.at"), "window")

    def near(batches):
        for batch in batches:
            hashes, at = batch.column(2).to_pylist(), batch.column(4).to_numpy()
            side = np.array([1 if a + 1 < len(h) else 2 if a else 0 for h, a in zip(hashes, at)], np.int32)
            other = np.array([h[a + 1] if s == 1 else h[a - 1] if s == 2 else 0 for h, a, s in zip(hashes, at, side)], np.int64).view(np.uint64)
            prefix = batch.column(3).to_numpy().view(np.uint64)
            key = np.zeros(len(at), np.uint64)
            for s in range(3):
                key[side == s] = _neighbour(prefix[side == s], other[side == s], s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array([len(h) for h in hashes], pa.int32()), pa.array(side), _signed(key)], names=["window", "words", "prefix", "at", "length", "side", "near"])

    found = found.select("window", "words", "hashes", "prefix", "at").mapInArrow(near, "window bigint, words string, prefix bigint, at int, length int, side int, near bigint")
    return materialize(found, "prefixes")


def _likely(w: Words, maps: list[np.ndarray]) -> np.ndarray:
    """Words that may be prefixes: with the neighbour on the side that a window has, or alone."""
    n = len(w.hashes)
    good = _on(maps[0], _neighbour(w.hashes, np.full(n, ALONE), 0)) if n else np.zeros(0, bool)
    if n > 1:
        same = w.doc[1:] == w.doc[:-1]
        good[:-1] |= same & _on(maps[1], _neighbour(w.hashes[:-1], w.hashes[1:], 1))
        good[1:] |= same & _on(maps[2], _neighbour(w.hashes[1:], w.hashes[:-1], 2))
    return np.flatnonzero(good)


def places(docs: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """For each row of ``docs`` (numbers, and text as the last column): the numbers, n_words, and the places that may be prefixes, with the words from ``first`` on around them."""
    keys = docs.columns[:-1]
    sides = [_bits(found.where(F.col("side") == s), "near") for s in range(3)]
    kind = pa.list_(pa.struct([("prefix", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.string())]))

    def look(batches):
        for batch, texts in blocks(batches):
            w = words(texts, "alnum")
            rows: list[list[dict]] = [[] for _ in range(len(texts))]
            for k in _likely(w, sides).tolist():
                d = int(w.doc[k])
                a, b = max(int(w.bounds[d]), k - size + 1), min(int(w.bounds[d + 1]), k + size)
                rows[d].append({"prefix": int(w.hashes[k].astype(np.int64)), "at": k - int(w.bounds[d]), "first": a - int(w.bounds[d]), "around": " ".join(_shown(w.word(i)) for i in range(a, b))})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(w.bounds), pa.int64()), pa.array(rows, kind)], names=[*keys, "n_words", "places"])

    schema = "".join(f"{k} bigint, " for k in keys) + "n_words bigint, places array<struct<prefix:bigint,at:int,first:int,around:string>>"
    return docs.mapInArrow(look, schema).withColumn("_row", F.monotonically_increasing_id())


def _hits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(_row, window, begin, end) of each verified occurrence; ``rows`` has _row, n_words and places."""
    each = rows.where(F.size("places") > 0).select("_row", "n_words", F.explode("places").alias("x")).select("_row", "n_words", "x.*").withColumnRenamed("at", "_at")
    begin = F.col("_at") - F.col("at")
    tried = each.join(found.select("window", "words", "prefix", "at", "length"), "prefix").where((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("around", " "), begin - F.col("first") + 1, F.col("length")), " ")
    return tried.where(there == F.col("words")).select("_row", "window", begin.alias("begin"), (begin + F.col("length")).alias("end"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_words, n_hit, items (their ids as sorted strings)."""
    docs = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    windows, items = windows_of(benchmark, size)
    found = prefixes(docs, windows)
    rows = materialize(places(docs, found, size), "places")
    hits = materialize(_hits(rows, found).distinct(), "hits")
    # words of an interval that lie beyond all before it
    before = Window.partitionBy("_row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    own = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = hits.select("_row", "begin", "end").distinct().select("_row", own.alias("n")).groupBy("_row").agg(F.sum("n").cast("bigint").alias("n_hit"))
    named = hits.select("_row", "window").distinct().join(items, "window").groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.select("_row", "doc_id", "n_words").join(n_hit, "_row", "left").join(named, "_row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has no hit. Rows of one text share their fate, so they are told apart by two hashes of it."""
    windows, _ = windows_of(benchmark, size)
    found = prefixes(docs, windows)
    h, g = F.xxhash64(text_of()), F.xxhash64(F.lit("again"), text_of())
    rows = materialize(places(docs.select(h.alias("h"), g.alias("g"), text_of().alias("text")), found, size).where(F.size("places") > 0), "places")
    one, two = free_name(docs, "_h"), free_name(docs, "_g")
    hit = rows.join(_hits(rows, found).select("_row").distinct(), "_row", "left_semi").select(F.col("h").alias(one), F.col("g").alias(two)).distinct()
    hit = materialize(hit, "hit")
    side = F.broadcast(hit) if hit.count() <= HIT else hit
    return docs.join(side, (h == F.col(one)) & (g == F.col(two)), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark, and the items these come from."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql("text")} AS w FROM benchmark),
part AS (SELECT DISTINCT item, least(len(w), {SIZE}) AS n, w[i:i + {SIZE - 1}] AS own FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {SIZE - 1}) + 1)) AS i FROM item WHERE len(w) > 0)),
text AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
place AS (SELECT r, n, i, w[i:i + n - 1] AS own FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM text, (SELECT DISTINCT n FROM part))),
hit AS (SELECT DISTINCT r, i, place.n, item FROM place JOIN part ON place.own = part.own),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM text LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
