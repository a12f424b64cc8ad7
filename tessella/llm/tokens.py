"""Exact BPE encoding with a bounded memo of space-separated chunks.

Both vocabularies split a text into pre-tokens that never join across a single space or line feed, so such
chunks can be encoded apart and remembered. The byte-level one also never joins a letter with a mark or digit
after it: a block of texts is cut there at once, and each distinct piece of it is asked for once. Texts with
other white space next to each other take the library's own path. Results are those of
``Tokenizer.encode(text, add_special_tokens=False)`` with ``encode_special_tokens`` set: the names of special
tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Chunks in the younger half of a worker's memo; when it is full it becomes the older half, from which used ones come back.
MEMO = 300_000
#: Longer chunks, in characters or bytes, are not remembered.
LONGEST = 256
_ODD_SPACE = re.compile(r"[^\S\n ]|\s\s|[\x1c-\x1f]")

#: Letters that lower-casing and normalisation map one to one, then marks: two pre-tokens.
_SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017E]*)([!-&(-/:-@\[-`{-~]*)")


def _shown_bytes() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next unused one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


_SHOWN = _shown_bytes()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """Chunk to ids, as bytes; an unknown chunk is encoded when it is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, chunk: str | bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def age(self) -> None:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()


#: Bytes that any white space but a space or a line feed begins with, and control characters that count as such here.
_RARE = bytes([9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3])

#: A piece of letters only, a space before them or not.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+")

#: What a byte after another one means: a piece begins, perhaps begins, or white space may stand there that forbids cuts.
_CUT, _PERHAPS, _LOOK = 1, 2, 4


def _pair_table() -> np.ndarray:
    """The meaning of each byte at the place 256 * the byte before it + the byte."""
    at = np.arange(256)
    letter = ((at | 32) >= ord("a")) & ((at | 32) <= ord("z"))
    mark, space = (at > 32) & (at < 127) & ~letter, (at == 32) | (at == 10)
    cut = (letter[:, None] & mark) | space | (at == 10)[:, None]
    look = (space[:, None] & space) | np.isin(at, list(_RARE))
    return (cut * _CUT + (((at >= 0x80) & (at < 0xC0))[:, None] & mark) * _PERHAPS + look * _LOOK).astype(np.uint8).ravel()


_PAIRS = _pair_table()


def _pieces(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin that can be encoded apart, in the bytes of texts that end at ``ends[1:]``."""
    pair = np.zeros(len(data), np.uint16)
    pair[1:] = data[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    pair[first] = 0
    pair <<= 8
    pair |= data
    kind = _PAIRS[pair]
    kind[first] |= _CUT
    at = np.flatnonzero(kind)
    kind = kind[at]
    cut = (kind & _CUT) > 0
    # A mark after a byte of no ASCII letter: letters of U+00C0 to U+017F are known by their two bytes.
    perhaps = np.flatnonzero(kind & _PERHAPS)
    lead, last = data[at[perhaps] - 2], data[at[perhaps] - 1]
    cut[perhaps] |= ((lead == 0xC3) & (last != 0x97) & (last != 0xB7)) | (lead == 0xC4) | (lead == 0xC5)
    for i in np.unique(np.searchsorted(ends, at[(kind & _LOOK) > 0], "right") - 1).tolist():
        a, b = ends[i], ends[i + 1]
        if _ODD_SPACE.search(data[a:b].tobytes().decode()):
            cut[np.searchsorted(at, a, "right") : np.searchsorted(at, b)] = False
    return at[cut]


class Encoder:
    """``encode(texts)`` gives one uint16 array of ids for each text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits are not supported")
        self.model = self.tok.model
        self.newline = self._ids("\n")
        self.byte_level = len(self.newline) > 0  # this vocabulary keeps white space
        self.marks: dict[str, bytes] = {}
        self.memo = _Memo(self._byte_piece if self.byte_level else self._word_chunk)

    def _ids(self, text: str) -> bytes:
        return array("H", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint16) for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids as little-endian unsigned 16-bit integers."""
        if self.byte_level:
            return self.encode_array(pa.array(texts, pa.large_string()))
        self.memo.age()
        get = self.memo.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]

    def encode_array(self, texts: pa.LargeStringArray) -> list[bytes]:
        """``encode_bytes`` of an Arrow array without nulls."""
        if not self.byte_level:
            return self.encode_bytes(texts.to_pylist())
        self.memo.age()
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if ends[0] == ends[-1]:
            return [b""] * len(texts)
        data, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        begin = _pieces(data, ends)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)]).dictionary_encode()
        _, at, known = pieces.dictionary.buffers()
        at, known = np.frombuffer(at, np.int64)[: len(pieces.dictionary) + 1].tolist(), known.to_pybytes()
        ids = pa.array(map(self.memo.__getitem__, [known[a:b] for a, b in zip(at, at[1:])]), pa.large_binary())
        _, at, ids = ids.take(pieces.indices).buffers()
        at, ids = np.frombuffer(at, np.int64)[np.searchsorted(begin, ends)].tolist(), ids.to_pybytes()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _letters(self, letters: str) -> bytes:
        """One pre-token of letters, encoded by the library's model."""
        return self._shown(letters.encode().decode("latin-1").translate(_SHOWN))

    def _shown(self, shown: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._ids(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = ids
        return ids

    def _byte_piece(self, piece: bytes) -> bytes:
        if piece[:1] == b" " and piece[1:].isalpha():
            return self._shown(_SHOWN[32] + piece[1:].decode())
        if _WORD.fullmatch(piece):
            return self._letters(piece.decode())
        return self._ids(piece.decode())

    def _word_chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha() and chunk.islower():
            return self._shown(chunk)
        m = _SIMPLE.fullmatch(chunk)
        if not m or not m[1]:
            return self._ids(chunk)
        word = m[1].lower()  # the last byte of a pre-token carries the end of the word
        ids = self.memo[word] if m[2] or word != chunk else self._letters(word)
        return ids + self._marks(m[2]) if m[2] else ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)
