"""Quality classifier from weak labels.

Heuristic labellers vote on each text: bad, good, or no opinion. Votes are counted by pattern over the whole corpus (at most 3**K patterns), and
expectation-maximisation on these counts estimates each labeller's accuracy on good and bad texts and the share of bad ones. The posterior of a pattern
is the training label of its texts. A linear scorer over hashed features (byte trigrams of the text, and binned
rates of symbols, capitals, repeats and marks) is then trained on the posteriors of a bounded sample and scores every text in full.

The sample: the ``SAMPLE`` texts of least hash for each side of the posterior. All else covers all rows.

Null and empty texts have only no opinions; they get the score of their features like any other. Repeated rows are counted and
scored each, rows without a doc_id too; the sample takes a text once. A very long text is a block of its own. Of texts with one hash, or votes with equal
posteriors, none goes first: the sample is the least hashes. On an empty table nothing is trained and no rows come out. ``keep_good`` passes columns of
any name on; the rest reads only doc_id and text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import blocks, keyed, materialize, table, text_of
from .textvec import U64, Words, mix, words

BUCKETS, SAMPLE, ROUNDS = 1 << 15, 3000, 60
#: Bytes of text that the kernels work on at once; their arrays take about 40 bytes for each, beside the batch that Spark sends.
KERNEL_BYTES = 1 << 17
#: Features that a training step holds at once.
ENTRIES = 1 << 18
#: What a labeller votes: bad, good, no opinion.
BAD, GOOD, NONE = 0, 1, 2
LABELLERS = ("symbols", "shouting", "stutter", "variety", "table", "lines", "marks", "punctuation")

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&<>!|"))
_MARK = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


def rates(w: Words) -> np.ndarray:
    """For each text: shares of symbols, capitals among letters, words equal to the last, distinct words, bars, repeated lines, words that end in a symbol, marks among all but white space; and n words."""
    data, n_docs = w.data, len(w.offsets) - 1
    ends = w.offsets

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[ends[1:]] - total[ends[:-1]]).astype(np.float64)

    n = np.diff(w.bounds)
    symbols = count(_SYMBOL[data] & (data != 124))
    upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
    same = np.zeros(len(w.hashes), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    stutter = np.bincount(w.doc[same], minlength=n_docs).astype(np.float64)
    order = np.lexsort((w.hashes, w.doc))
    h, d = w.hashes[order], w.doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[first], minlength=n_docs).astype(np.float64)
    bars = count(data == 124)
    # lines by their hash: the words' hashes added up with their place in the line
    feed = np.concatenate(([0], np.cumsum(data == 10)))
    line = feed[w.starts] + w.doc  # ascending; a new text is a new line too
    lines = np.zeros(n_docs)
    n_lines = np.ones(n_docs)
    if len(line):
        head = np.concatenate(([0], np.flatnonzero(np.diff(line)) + 1))
        place = (np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line))))).astype(np.uint64)
        key = np.add.reduceat(mix(w.hashes + place * U64(0x9E3779B97F4A7C15)), head)
        own = w.doc[head]
        o = np.lexsort((key, own))
        again = np.zeros(len(o), bool)
        again[1:] = (key[o][1:] == key[o][:-1]) & (own[o][1:] == own[o][:-1])
        lines = np.bincount(own[o][again], minlength=n_docs).astype(np.float64)
        n_lines = np.maximum(np.bincount(own, minlength=n_docs), 1)
    some = np.maximum(n, 1)
    last = np.bincount(w.doc[_SYMBOL[data[w.ends - 1]]], minlength=n_docs).astype(np.float64)
    marks, solid = count(_MARK[data]), count(data > 32)
    return np.stack([symbols / some, upper / np.maximum(upper + lower, 1), stutter / some, distinct / some, bars / some, lines / n_lines, last / some, marks / np.maximum(solid, 1), n.astype(np.float64)], axis=1)


def votes(r: np.ndarray) -> np.ndarray:
    """The labellers' votes (texts x labellers) from the rates."""
    n = r[:, 8]

    def vote(bad, good):
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    long = n >= 40
    return np.stack(
        [
            vote(r[:, 0] > 0.5, r[:, 0] < 0.1),
            vote((r[:, 1] > 0.5) & (n >= 5), r[:, 1] < 0.15),
            vote((r[:, 2] > 0.2) & (n >= 5), (r[:, 2] < 0.08) & (n >= 5)),
            vote(long & (r[:, 3] < 0.25), long & (r[:, 3] > 0.4)),
            vote((r[:, 4] > 0.3) & (n >= 5), r[:, 4] < 0.05),
            vote((r[:, 5] > 0.3), (r[:, 5] < 0.1) & long),
            vote((r[:, 6] > 0.3) & (n >= 5), r[:, 6] < 0.05),
            vote((r[:, 7] > 0.09) & (n >= 20), r[:, 7] < 0.06),
        ],
        axis=1,
    )


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of bad texts and p[labeller, class, vote], by expectation-maximisation over vote patterns.

    No opinion says nothing about a text. It starts from labellers that find part of the bad texts and seldom blame good
    ones, so the classes keep their meaning; the pseudo-counts do so where a table has hardly any bad texts.
    """
    share, k = 0.1, patterns.shape[1]
    start = np.array([[0.3, 0.7], [0.01, 0.99]])
    p = np.tile(start, (k, 1, 1))
    for _ in range(rounds):
        q = posterior(patterns, share, p)
        share = float(np.clip((q * counts).sum() / max(counts.sum(), 1), 0.001, 0.999))
        for j in range(k):
            for v in (BAD, GOOD):
                at = patterns[:, j] == v
                p[j, 0, v] = (q[at] * counts[at]).sum() + 10 * start[0, v]
                p[j, 1, v] = ((1 - q[at]) * counts[at]).sum() + 10 * start[1, v]
        p /= p.sum(axis=2, keepdims=True)
    return share, p


def posterior(patterns: np.ndarray, share: float, p: np.ndarray) -> np.ndarray:
    """The probability that a text with these votes is bad."""
    log = np.tile(np.log(np.array([share, 1 - share])), (len(patterns), 1))
    said = np.concatenate((np.log(p), np.zeros((len(p), 2, 1))), axis=2)  # no opinion counts for nothing
    for j in range(patterns.shape[1]):
        log += said[j][:, patterns[:, j]].T
    log -= log.max(axis=1, keepdims=True)
    e = np.exp(log)
    return e[:, 0] / e.sum(axis=1)


_EDGES = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8])


def features(w: Words, r: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and weight of each hashed feature of each text; byte trigrams have a share of 1 in total, each rate's bin one."""
    data = w.data.astype(np.int64)
    n = len(data)
    gram = np.zeros(n, np.int64)
    if n > 2:
        gram[: n - 2] = ((data[:-2] * 65_599 + data[1:-1]) * 65_599 + data[2:]) * 2_654_435_761 >> 7 & (BUCKETS // 2 - 1)
    bins = np.digitize(r[:, :8], _EDGES)
    shape = (mix((np.arange(8) * 16 + bins).astype(np.uint64)) & U64(BUCKETS // 2 - 1)).astype(np.int64) + BUCKETS // 2
    out = []
    for i in range(len(w.offsets) - 1):
        a, b = w.offsets[i], w.offsets[i + 1]
        if b - a > 2:
            count = np.bincount(gram[a : b - 2])
            at = np.flatnonzero(count)
            out.append((np.concatenate((at, shape[i])), np.concatenate((count[at] / (b - a - 2), np.full(8, 0.5))).astype(np.float32)))
        else:
            out.append((shape[i], np.full(8, 0.5, np.float32)))
    return out


def spool(rows: Iterable[Row], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each row (at, x, q), its buckets, weights and target, as files in ``folder``: the driver holds a row at a time, whatever the length of texts."""
    sizes, target = [], []
    with open(f"{folder}/at", "wb") as at, open(f"{folder}/x", "wb") as x:
        for r in rows:
            at.write(r.at)
            x.write(r.x)
            sizes.append(len(r.x) // 4)
            target.append(r.q)
    mapped = [np.memmap(f"{folder}/{name}", kind, "r") if sizes else np.zeros(0, kind) for name, kind in (("at", np.uint16), ("x", np.float32))]
    return np.array(sizes, np.int64), *mapped, np.array(target)


def train(sizes: np.ndarray, at: np.ndarray, x: np.ndarray, target: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Logistic regression on soft labels by full-batch gradient steps with per-weight rates; the bias comes last. A step adds up blocks of texts."""
    weights = np.zeros(BUCKETS + 1)
    if not len(sizes):
        return weights
    bounds = np.append(0, np.cumsum(sizes))
    cuts = [0]
    while cuts[-1] < len(sizes):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + ENTRIES, "right")) - 1))
    square = np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        grad = np.zeros(BUCKETS + 1)
        for a, b in pairwise(cuts):
            own, value = at[bounds[a] : bounds[b]].astype(np.int64), x[bounds[a] : bounds[b]].astype(np.float64)
            doc = np.repeat(np.arange(b - a), sizes[a:b])
            z = np.bincount(doc, value * weights[own], minlength=b - a) + weights[-1]
            error = 1 / (1 + np.exp(-z)) - target[a:b]
            grad += np.append(np.bincount(own, value * error[doc], minlength=BUCKETS), error.sum())
        grad = grad / len(sizes) + 1e-6 * weights
        square += grad * grad
        weights -= 0.5 * grad / np.sqrt(square)
    return weights


def fit(docs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of bad texts, labeller accuracies and scorer weights from all of ``docs`` (text)."""
    k = len(LABELLERS)
    base = 3 ** np.arange(k)

    def vote(batches):
        for batch, texts in blocks(batches, limit=KERNEL_BYTES):
            code = votes(rates(words(texts, lower=False))) @ base
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.astype(np.int32))], names=["h", "code"])

    hashed = docs.select(F.xxhash64("text").alias("h"), "text")
    voted = materialize(hashed.mapInArrow(vote, "h bigint, code int"), "votes")  # the labellers read each text once
    some = sorted((r.code, r.n) for r in voted.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect())
    codes, counts = np.array([c for c, _ in some], np.int64), np.array([n for _, n in some], np.int64)
    patterns = codes[:, None] // base[None, :] % 3
    share, p = em(patterns, counts)
    bad = codes[posterior(patterns, share, p) > 0.5].tolist()

    def sample(batches):
        for batch, texts in blocks(batches, limit=KERNEL_BYTES):
            w = words(texts, lower=False)
            r = rates(w)
            q = posterior(votes(r), share, p)
            own = features(w, r)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array([a.astype(np.uint16).tobytes() for a, _ in own], pa.binary()), pa.array([v.tobytes() for _, v in own], pa.binary())], names=["h", "q", "at", "x"])

    sides = [F.col("code").isin(bad), ~F.col("code").isin(bad)]
    picked = [r.h for side in sides for r in voted.where(side).select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    chosen = docs.sparkSession.createDataFrame([(h,) for h in picked], "h bigint")
    rows = hashed.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"]).mapInArrow(sample, "h bigint, q double, at binary, x binary").orderBy("h")
    with tempfile.TemporaryDirectory(prefix="tessella-") as folder:
        return share, p, train(*spool(rows.toLocalIterator(), folder))


def classify(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): posterior of the votes, score (both: probability of bad) and kept (score under 0.5)."""
    docs = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    share, p, weights = model or fit(docs)

    def run(batches):
        for batch, texts in blocks(batches, limit=KERNEL_BYTES):
            q, z = _scores(texts, share, p, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(q, 6)), pa.array(np.round(z, 6)), pa.array(z < 0.5)], names=["doc_id", "posterior", "score", "kept"])

    return docs.mapInArrow(run, "doc_id bigint, posterior double, score double, kept boolean")


def _scores(texts: pa.Array, share: float, p: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words(texts, lower=False)
    r = rates(w)
    z = np.array([weights[at] @ x for at, x in features(w, r)]) + weights[-1]
    return posterior(votes(r), share, p), 1 / (1 + np.exp(-z))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under 0.5; nothing is shuffled, and each text goes to Python once."""
    share, p, weights = fit(docs.select(text_of().alias("text")))
    names = docs.columns
    at = names.index("text") if "text" in names else [c.lower() for c in names].index("text")

    def run(batches):
        for batch, texts in blocks(batches, at, KERNEL_BYTES):
            _, z = _scores(texts, share, p, weights)
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(z < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"))
