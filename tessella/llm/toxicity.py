"""Toxicity by noisy-channel deobfuscation.

Restoring: tokens with digits or signs among or after letters, letters repeated three times or more, and runs of single characters set apart
("i d i o t", "(i-d.i o_t,") become character lattices. Each place offers what may have been meant (the character, the letters it is drawn for, one or two
of a repeated letter, nothing for a sign at the end); each separator of a run is nothing or a word's edge, so that "y o u i d i o t" has two words. Viterbi decoding under a character trigram model of the corpus, with a cost for each change, picks
the text. Other tokens have a single path and stay as they are.

Scoring: features are the distinct words of the restored text and their first bytes (4 to 8), hashed. On labelled rows the documents with
each feature are counted by label; those with an excess of over three standard deviations in toxic texts are kept, and a logistic scorer is trained on them
with the ``TRAIN`` labelled texts whose doc_id has the least hash, toxic ones weighing ``RARE`` times as much. The counts, the character model and the scores cover all rows.

Only the text is an input. Rows with crc32(doc_id) mod 5 = 0 are never learnt from. Null and empty texts score by the
bias alone. Repeated rows are scored each, rows without a doc_id too (not held out); of rows that share a doc_id the sample has one, the least text. A very long
token is decoded in time and memory that grow with its length. Without labelled rows all scores are the bias, 0.5. An empty table gives no rows. Other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, keyed, table, text_of
from .textvec import _ODD, _SHORT, _TABLE, U64, mix, words
from .vectors import sum_vectors, with_labels

BUCKETS, TRAIN, ROUNDS, RARE = 1 << 20, 20_000, 800, 3.0
#: Longest token whose reading is remembered.
REMEMBERED = 64
PREFIXES = (4, 5, 6, 7, 8)
#: Letters that digits and signs are drawn for.
DRAWN = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SWAP, KEEP, FOLD, JOIN = 0.7, 4.0, 0.3, 0.2

_SEPARATOR = r"[\s\"#%&'()*,./:;<=>?\[\\\]^_`{}~-]{1,3}"
#: Three or more single characters set apart, whatever stands around them; a "!" at the end is none of them.
_RUN = rf"(?<![^\W_])[A-Za-z0-9@$!|+](?:{_SEPARATOR}[A-Za-z0-9@$!|+])+{_SEPARATOR}[A-Za-z0-9@$|+](?![^\W_])(?![@$!|+]+[^\W_])"
_HARD = re.compile(r"[0-9@$!|+][A-Za-z]|[A-Za-z][0-9@$|+]|([A-Za-z])\1\1")
_APART = re.compile(_RUN)
_HINT = re.compile(rf"{_HARD.pattern}|{_RUN}")
_BETWEEN = re.compile(_SEPARATOR)
_TOKEN = re.compile(r"[^\s]+")
_EDGE = re.compile(r"^[^A-Za-z0-9@$!|+]+|[^A-Za-z0-9@$|+]+$")
#: Stands for a separator in a run; no token holds it.
_GAP = "\n"
#: 0 is a word's edge, 1 to 26 are letters, 27 is any other byte.
_CODE = np.full(256, 27, np.int64)
_CODE[97:123] = np.arange(1, 27)
_N = 28


def character_model(docs: DataFrame) -> np.ndarray:
    """-log p(c | a, b) of lower-cased characters within words, counted over all of ``docs`` (text)."""

    def count(batches, total):
        for _, texts in blocks(batches):
            w = words(texts, "alnum")
            if not len(w.starts):
                continue
            sizes = w.ends - w.starts
            shift = np.cumsum(sizes + 2) - (sizes + 2)  # each word between two edges
            code = np.zeros(int((sizes + 2).sum()), np.int64)
            at = np.repeat(w.starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code[at - np.repeat(w.starts, sizes) + np.repeat(shift + 1, sizes)] = _CODE[w.data[at]]
            total[: _N**3] += np.bincount((code[:-2] * _N + code[1:-1]) * _N + code[2:], minlength=_N**3)

    c = sum_vectors(docs.select("text"), count, _N**3).reshape(_N, _N, _N) + 0.5
    return -np.log(c / c.sum(axis=2, keepdims=True))


def _options(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a lower-cased token: for each run of one character, what it may stand for and the cost.

    A gap is nothing or a word's edge (a blank). Signs at the end of a token may also be no letters at all.
    """
    out, i = [], 0
    end = len(token) if _GAP in token else len(token.rstrip("@$|+"))
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        if c == _GAP:
            out.append([("", JOIN), (" ", 0.0)])
            i = j
            continue
        meant = [(c, 0.0 if c.isalpha() else KEEP)] + [(x, SWAP) for x in DRAWN.get(c, "")]
        meant += [("", KEEP)] if i >= end else []
        if n < 3:
            out += [meant] * n
        else:
            out.append([(x * k, cost + FOLD * k) for x, cost in meant for k in (1, 2)])
        i = j
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-cased token (Viterbi; a state is the last two characters). Of equal ones the first that is found stays."""
    states: dict[tuple[int, int], float] = {(27, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for options in _options(token):
        ahead: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), cost in sorted(states.items()):
            for piece, own in options:
                x, y, total = a, b, cost + own
                if piece == " ":
                    x, y, total = 0, 0, total + float(model[a, b, 0])
                for c in piece.strip(" "):
                    z = ord(c) - 96 if "a" <= c <= "z" else 27
                    total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in ahead or total < ahead[x, y]:
                    ahead[x, y], came[x, y] = total, ((a, b), piece)
        states = ahead
        back.append(came)
    at = min((cost + float(model[a, b, 0]), (a, b)) for (a, b), cost in states.items())[1]
    pieces = []
    for came in reversed(back):
        at, piece = came[at]
        pieces.append(piece)
    return "".join(reversed(pieces))


class Restorer:
    """Restores whole texts; a token's reading is remembered."""

    def __init__(self, model: np.ndarray):
        remembered = lru_cache(maxsize=200_000)(lambda token: decode(token, model))
        self.read = lambda token: remembered(token) if len(token) <= REMEMBERED else decode(token, model)

    def __call__(self, text: str) -> str:
        if not _HINT.search(text):
            return text
        text = _APART.sub(lambda m: self.read(_BETWEEN.sub(_GAP, m[0]).lower()) if any(c.isalpha() for c in m[0]) else m[0], text)
        return _TOKEN.sub(lambda m: self._token(m[0]) if _HARD.search(m[0]) else m[0], text)

    def _token(self, token: str) -> str:
        core = _EDGE.sub("", token)
        return self.read(core.lower()) if core and any(c.isalpha() for c in core) else token


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each distinct feature of each text, in order."""
    w = words(pa.array(texts, pa.large_string()), "alnum")
    parts = [(w.doc, mix(w.hashes))]
    sizes = w.ends - w.starts
    head = np.zeros(len(sizes), np.uint64)
    for k in range(max(PREFIXES)):  # the hash of a word's first bytes is the sum of their values
        some = np.flatnonzero(sizes > k)
        key = k * 256 + w.data[w.starts[some] + k].astype(np.int64)
        head[some] += _TABLE[key] if k < _SHORT else mix((key.astype(np.uint64) + U64(1)) * _ODD[0])
        if k + 1 in PREFIXES:
            long = np.flatnonzero(sizes > k + 1)
            parts.append((w.doc[long], mix(head[long] ^ _ODD[k % len(_ODD)])))
    doc = np.concatenate([d for d, _ in parts])
    own = (np.concatenate([h for _, h in parts]) & U64(BUCKETS - 1)).astype(np.int64)
    both = np.unique(doc * BUCKETS + own)
    return both // BUCKETS, both % BUCKETS


def _restored(texts: pa.Array, restore: Restorer) -> list[str]:
    return [restore(t) for t in texts.to_pylist()]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character model, the kept buckets (ascending), and their weights with the bias last."""
    model = character_model(docs)
    learn = with_labels(docs, labels, "toxic", "inner").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("text", "_label", F.xxhash64("doc_id").alias("_h"))

    def count(batches, total):
        restore, parts = Restorer(model), total[: 2 * BUCKETS + 2]
        for batch, texts in blocks(batches):
            label = (batch.column(1).to_numpy(zero_copy_only=False) == 1).astype(np.int64)
            doc, own = buckets(_restored(texts, restore))
            at, c = np.unique(own + BUCKETS * label[doc], return_counts=True)
            parts[at] += c
            parts[2 * BUCKETS :] += np.bincount(label, minlength=2)

    counts = sum_vectors(learn, count, 2 * BUCKETS + 2)
    clean, toxic, (n_clean, n_toxic) = counts[:BUCKETS], counts[BUCKETS : 2 * BUCKETS], counts[-2:]
    if not n_toxic or not n_clean:
        return model, np.zeros(0, np.int64), np.zeros(1)
    share = n_toxic / (n_clean + n_toxic)
    expected = (clean + toxic) * share
    excess = np.where(toxic >= 3, (toxic - expected) / np.sqrt(expected * (1 - share) + 1), 0)
    kept = np.flatnonzero(excess > 3)

    def look(batches):
        restore = Restorer(model)
        for batch, texts in blocks(batches, "text"):
            doc, own = buckets(_restored(texts, restore))
            k = np.searchsorted(kept, own)
            good = (k < len(kept)) & (kept[np.minimum(k, len(kept) - 1)] == own)
            doc, k = doc[good], k[good].astype(np.int32)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([k[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["label", "at"])

    if not len(kept):
        return model, kept, np.array([np.log(share / (1 - share))])
    # the hashes of the sample first, without texts, so that no task gathers more than a bounded number of rows
    last = learn.select("_h").distinct().orderBy("_h").limit(TRAIN).agg(F.max("_h")).first()[0]
    sample = learn.where(F.col("_h") <= F.lit(last)).groupBy("_h").agg(F.min(F.struct("text", "_label")).alias("r"))  # rows that repeat a doc_id are one
    rows = sample.select("r.text", F.col("r._label").alias("label")).mapInArrow(look, "label int, at binary").collect()
    rows.sort(key=lambda r: (bytes(r["at"]), r.label))
    at = np.concatenate([np.frombuffer(bytes(r["at"]), np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r["at"]) // 4 for r in rows])
    y = np.array([float(r.label == 1) for r in rows])
    weight = np.where(y > 0, RARE, 1.0)
    weights, square = np.zeros(len(kept) + 1), np.full(len(kept) + 1, 1e-8)
    for _ in range(ROUNDS):
        z = np.bincount(doc, weights[at], minlength=len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        grad = np.append(np.bincount(at, error[doc], minlength=len(kept)), error.sum()) / len(rows) + 1e-6 * weights
        square += grad * grad
        weights -= 0.3 * grad / np.sqrt(square)
        weights[:-1] = np.maximum(weights[:-1], 0)  # a feature that is commoner in toxic texts never speaks for a clean one
    return model, kept, weights


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): held_out, score and predicted; ``labels`` has doc_id, toxic."""
    docs = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    model, kept, weights = fit(docs, labels)

    def run(batches):
        restore = Restorer(model)
        for batch, texts in blocks(batches):
            doc, own = buckets(_restored(texts, restore))
            z = np.full(len(texts), weights[-1])
            if len(kept):
                k = np.minimum(np.searchsorted(kept, own), len(kept) - 1)
                good = kept[k] == own
                z += np.bincount(doc[good], weights[k[good]], minlength=len(texts))
            p = np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", "text", out.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from four fifths of the labelled ones."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
