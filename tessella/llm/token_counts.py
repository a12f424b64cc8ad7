"""Offset-mapped token attribution: encode a whole text once, then join token spans to sections.

Each token has a character span in the text; sections are character spans too. The join is an interval join by
binary search in the sorted section starts. A token that crosses a boundary is allocated by an explicit rule:

``start``     the section that holds its first character;
``majority``  the section that holds most of its characters, the earlier one on a tie.

Either way every token counts once, so the counts of a text's sections add up to its tokens.

A null or empty text has one empty section without tokens. Repeated rows are counted each, rows without a doc_id too. A very long text is encoded as
a whole, in a block of its own; memory grows with the longest text. An empty table gives no rows. Columns that are not named are not read, so names can't clash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, keyed, table, text_of
from .tokens import encoder, tokenizer_path


@lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id of a byte-level vocabulary stands for: one a printed character."""
    enc = encoder(path)
    if not enc.byte_level:
        raise ValueError("spans need a vocabulary that keeps every byte of the text")
    vocab = enc.tok.get_vocab()
    sizes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        sizes[i] = len(token)
    return sizes


def spans(ids: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) character of each token. A token inside a character has that character's span."""
    end = np.cumsum(sizes[ids])
    begin = end - sizes[ids]
    head = (data & 0xC0) != 0x80
    if head.all():
        return begin, end
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(head, out=before[1:])
    return before[np.minimum(begin + 1, len(data))] - 1, before[end]


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For sections that start at ``starts`` (the first at 0): tokens of each, and its tokens that cross into another."""
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, np.maximum(end - 1, begin), "right") - 1
    crosses = last > first
    home = first.copy()
    if rule == "majority" and crosses.any():
        limits = np.append(starts, np.iinfo(np.int64).max)
        for i in np.flatnonzero(crosses):
            k = np.arange(first[i], last[i] + 1)
            shared = np.minimum(limits[k + 1], end[i]) - np.maximum(limits[k], begin[i])
            home[i] = k[np.argmax(shared)]
    elif rule not in ("start", "majority"):
        raise ValueError(f"unknown rule {rule}")
    n = len(starts)
    return np.bincount(home, minlength=n), np.bincount(home[crosses], minlength=n)


_SCHEMA = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint"


def count_sections(docs: DataFrame, path: str, rule: str = "majority") -> DataFrame:
    """Tokens of each line of each text of ``docs`` (doc_id, text); a line feed belongs to the line it ends."""

    def count(batches):
        enc, sizes = encoder(path), token_bytes(path)
        for batch, texts in blocks(batches):
            out: list[list[np.ndarray]] = []
            strings = texts.to_pylist()
            for doc_id, text, raw in zip(batch.column(0).to_pylist(), strings, enc.encode_bytes(strings)):
                data = np.frombuffer(text.encode(), np.uint8)
                begin, end = spans(np.frombuffer(raw, np.uint16), sizes, data)
                feeds = np.flatnonzero(data == 10) + 1
                head = (data & 0xC0) != 0x80
                if not head.all():
                    feeds = np.cumsum(head)[feeds - 1]
                length = int(head.sum())
                starts = np.concatenate(([0], feeds[feeds < length]))
                tokens, crossing = attribute(begin, end, starts, rule)
                n = len(starts)
                out.append([np.full(n, -1 if doc_id is None else doc_id), np.full(n, doc_id is None), np.arange(n), starts, np.append(starts[1:], length), tokens, crossing])
            if out:
                ids, null, *rest = [np.concatenate(c) for c in zip(*out)]
                kinds = [pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64), pa.int64(), mask=null), *[pa.array(c, k) for c, k in zip(rest, kinds)]], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(count, _SCHEMA)


def count_fields(rows: DataFrame, fields: list[str], path: str, rule: str = "majority", key: str = "doc_id") -> DataFrame:
    """Tokens of each named field when a row's fields are encoded as one text, joined by line feeds.

    Fields may hold line feeds themselves; they are masked so that each field is one section.
    """
    texts: list[Column] = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    joined = rows.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.concat_ws("\n", *texts).alias("text"), F.array(*[F.length(t) + 1 for t in texts[:-1]]).alias("sizes"))

    def count(batches):
        enc, sizes = encoder(path), token_bytes(path)
        for batch, strings in blocks(batches):
            plain, out = strings.to_pylist(), []
            for doc_id, text, own, raw in zip(batch.column(0).to_pylist(), plain, batch.column(2).to_pylist(), enc.encode_bytes(plain)):
                begin, end = spans(np.frombuffer(raw, np.uint16), sizes, np.frombuffer(text.encode(), np.uint8))
                starts = np.concatenate(([0], np.cumsum(own).astype(np.int64)))
                tokens, crossing = attribute(begin, end, starts, rule)
                out += [(doc_id, k, int(a), int(b), int(t), int(c)) for k, (a, b, t, c) in enumerate(zip(starts, np.append(starts[1:], len(text)), tokens, crossing))]
            if out:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return joined.mapInArrow(count, _SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole text."""
    return count_sections(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
