"""Token-ID files: a shared zstandard dictionary, one frame for each document, and an index for direct access.

A file set is a folder with two Parquet datasets:

``meta``    one row: format version, tokenizer file, end id, dictionary and its SHA-256.
``blocks``  rows of up to ``BLOCK`` documents in ascending doc_id: part, block, doc_ids, n_tokens, ends (where each
            document's frame ends in payload), payload (the frames one after the other) and the dictionary's SHA-256.

Ids are little-endian unsigned 16-bit integers inside a frame. One document is read by its block's statistics,
its entry in ``ends`` and one decompression with the dictionary, whatever the size of the set.

A null text is an empty one (just the end id). Rows with a null doc_id come first; rows that share a doc_id
stay separate rows in no fixed order among themselves. An empty table gives an empty set with an empty dictionary. A very long
text is one frame in its block, and no sample of the dictionary. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, keyed, scratch, table, text_of
from .tokens import encoder, tokenizer_path

#: Documents in one block.
BLOCK = 256
#: Bytes of text that are encoded at once: in larger blocks a piece more often stands again.
ENCODE_BYTES = 2 << 20
#: The dictionary is trained on the ids of the texts with this many least hashes of doc_id, of at most SAMPLE_CHARS each.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 500, 20_000, 32_768
_BLOCKS = "part int, block int, dictionary string, doc_ids array<bigint>, n_tokens array<int>, ends array<int>, payload binary"


def train_dictionary(docs: DataFrame, path: str, end_id: int = 0) -> bytes:
    """Train on the serialized ids of a bounded sample of ``docs``; empty where there is too little to learn from."""
    import zstandard

    h = F.xxhash64("doc_id")
    least = docs.select(h.alias("h")).distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).first()[0]
    rows = docs.where((h <= F.lit(least)) & F.length("text").between(1, SAMPLE_CHARS)).select("text").orderBy("text").limit(SAMPLE_TEXTS).collect() if least is not None else []
    tail = np.array([end_id], np.uint16).tobytes()
    samples = [x + tail for x in encoder(path).encode_bytes([r.text for r in rows])]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 and size >= 512 else b""


def _zstd(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """Cuts of doc_id into about ``n`` even ranges, from the doc_id column alone."""
    if n < 2:
        return []
    row = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first()
    return sorted(set(row.q or []))


def write_ids(docs: DataFrame, out: str, path: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write a file set to the folder ``out``, in ascending doc_id order."""
    spark = docs.sparkSession
    docs = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    dictionary = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _bounds(docs, n)
    spark.createDataFrame([(1, path, end_id, bytearray(dictionary), digest)], "version int, tokenizer string, end_id int, dictionary binary, sha256 string").coalesce(1).write.parquet(f"{out}/meta")

    def encode(batches):
        enc, (press, _), tail = encoder(path), _zstd(dictionary), np.array([end_id], np.uint16).tobytes()
        at = np.array(cuts, np.int64)
        for batch, texts in blocks(batches, limit=ENCODE_BYTES):
            raw = [x + tail for x in enc.encode_array(texts)]
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(at, ids, "left").astype(np.int32)), batch.column(0), pa.array([len(x) // 2 for x in raw], pa.int32()), pa.array([press.compress(x) for x in raw], pa.binary())], names=["part", "doc_id", "n", "frame"])

    def pack(batches):
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(a, BLOCK)
                frames = rows.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([digest]), pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([rows.column(1).to_pylist()], pa.list_(pa.int32())), pa.array([np.cumsum([len(x) for x in frames]).tolist()], pa.list_(pa.int32())), pa.array([b"".join(frames)], pa.binary())], names=["part", "block", "dictionary", "doc_ids", "n_tokens", "ends", "payload"])
                block += 1

    frames = docs.mapInArrow(encode, "part int, doc_id bigint, n int, frame binary")
    ordered = frames.repartitionById(len(cuts) + 1, "part").drop("part").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(pack, _BLOCKS).write.parquet(f"{out}/blocks")


def read_ids(spark: SparkSession, out: str, checksum: bool = False) -> DataFrame:
    """Read a file set: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 16-bit).

    With ``checksum``, ids_crc32 stands for ids: the crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    meta = spark.read.parquet(f"{out}/meta").first()
    dictionary, digest = bytes(meta.dictionary), meta.sha256
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary of {out} is damaged")
    stored = spark.read.schema(_BLOCKS).parquet(f"{out}/blocks")
    # A row for each block: its place is what all blocks before it hold. Parts are as many as the writer's partitions.
    size = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda s, x: s + x)
    sums = stored.groupBy("part").agg(F.sum(size).alias("n")).collect()
    base, total = {}, 0
    for r in sorted(sums, key=lambda r: r.part):
        base[r.part], total = total, total + r.n
    before = F.sum("size").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored.select("part", "block", size.alias("size")).select("part", "block", F.coalesce(before, F.lit(0)).alias("before"))

    def unpack(batches):
        _, open_ = _zstd(dictionary)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dictionary"] != digest:
                    raise ValueError("a block was written with another dictionary")
                at, ends = base[r["part"]] + r["before"], [0, *r["ends"]]
                ids = [open_.decompress(r["payload"][a:b]) for a, b in zip(ends, ends[1:])]
                n = np.array(r["n_tokens"], np.int64)
                if [len(x) // 2 for x in ids] != r["n_tokens"]:
                    raise ValueError("a block's index doesn't match its frames")
                last = pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], pa.int64()) if checksum else pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(at + np.cumsum(n) - n), pa.array(n), last], names=["doc_id", "start", "n_tokens", kind.split()[0]])

    kind = "ids_crc32 bigint" if checksum else "ids binary"
    return stored.join(starts, ["part", "block"]).mapInArrow(unpack, f"doc_id bigint, start bigint, n_tokens bigint, {kind}")


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[int] | None:
    """The ids of one document: one block is read, one frame decompressed."""
    meta = spark.read.parquet(f"{out}/meta").first()
    row = spark.read.schema(_BLOCKS).parquet(f"{out}/blocks").where((F.element_at("doc_ids", 1) <= doc_id) & (F.element_at("doc_ids", -1) >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id).cast("bigint"))).limit(1).collect()
    if not row:
        return None
    k, ends = row[0].doc_ids.index(doc_id), [0, *row[0].ends]
    return np.frombuffer(_zstd(bytes(meta.dictionary))[1].decompress(bytes(row[0].payload)[ends[k] : ends[k + 1]]), np.uint16).tolist()


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token-ID files, read them back, and give each document's place and checksum."""
    out = scratch(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), out, tokenizer_path("byte_bpe_50k.json"))
    return read_ids(spark, out, checksum=True)
