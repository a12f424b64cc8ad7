"""Word splitting and hashing of many texts at once, on their UTF-8 bytes with numpy.

A word's hash is the sum, modulo 2**64, of one mixed 64-bit value for each (position, byte) pair,
so it depends on the bytes alone: the same on every executor and in every run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SHORT = 64
_TABLE = mix((np.arange(_SHORT * 256, dtype=np.uint64) + U64(1)) * _ODD[0])


def _separators(kind: str) -> np.ndarray:
    sep = np.zeros(256, bool)
    if kind == "space":  # words [^\x20\x09-\x0D]+
        sep[[0x20, 9, 10, 11, 12, 13]] = True
    else:  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
        sep[:0x80] = True
        sep[0x30:0x3A] = False
        sep[0x61:0x7B] = False
    return sep


SEPARATORS = {k: _separators(k) for k in ("space", "alnum")}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a block of texts: hashes in text order, and which words each text has."""

    hashes: np.ndarray  # uint64 for each word
    doc: np.ndarray  # index of each word's text
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]
    starts: np.ndarray  # first byte of each word, in the block
    ends: np.ndarray  # one past its last byte
    data: np.ndarray  # the bytes, lower-cased if asked for
    offsets: np.ndarray  # first byte of each text

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, kind: str = "space", lower: bool = True) -> Words:
    data, offsets = bytes_of(texts)
    if lower:
        data = LOWER[data]
    inside = ~SEPARATORS[kind][data]
    n = len(data)
    heads = offsets[:-1][offsets[:-1] < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[heads] = False
    begin = inside & ~before
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    tails = heads[heads > 0] - 1
    after[tails] = False
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    if not len(starts):
        return Words(np.zeros(0, np.uint64), doc, bounds, starts, ends, data, offsets)
    at = np.flatnonzero(inside)
    sizes = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(sizes[:-1], out=first[1:])
    position = np.arange(len(at)) - np.repeat(first, sizes)
    key = position * 256 + data[at]
    value = _TABLE[key] if sizes.max() <= _SHORT else mix((key.astype(np.uint64) + U64(1)) * _ODD[0])
    return Words(np.add.reduceat(value, first), doc, bounds, starts, ends, data, offsets)


def hash_word(word: bytes) -> int:
    """What ``words`` gives as the hash of a single word."""
    key = np.arange(len(word), dtype=np.uint64) * U64(256) + np.frombuffer(word, np.uint8).astype(np.uint64)
    return int(mix((key + U64(1)) * _ODD[0]).sum(dtype=np.uint64))


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of ``size`` consecutive words of one text."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = w.hashes[:n] * _ODD[0]
    for k in range(1, size):
        total = total + mix(w.hashes[k : k + n] + _ODD[k % len(_ODD)]) * _ODD[(k + 1) % len(_ODD)]
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 : size - 1 + n])
    return mix(total[at]), at


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of one short word sequence as a whole; its length is part of it."""
    with np.errstate(over="ignore"):
        total = U64(len(hashes)) * _ODD[9]
        for k, h in enumerate(hashes):
            total = total + mix(np.array([h + _ODD[k % len(_ODD)]], np.uint64))[0] * _ODD[(k + 3) % len(_ODD)]
    return mix(np.array([total], np.uint64))[0]
