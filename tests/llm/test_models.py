"""The fitted operators against plain versions, one document or one reading at a time."""

import math
import os
import re
import sys
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))

from tessella.llm import quality_classifier, quality_rules, toxicity
from tessella.llm.textvec import hash_word, mix, words

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "a b c", "é" * 3, "the same words stand here again and again", "the same words stand here again and again", "x " * 3000, "a" * 50_000, "#### $$$ 12 %% || ||", "A B\nA B\nC D\n", "1d1ot i d i o t"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id at all")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def spark_hash(*values) -> int:
    """Spark's xxhash64 of an int and strings."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(4, "little") if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def test_rule_scores_are_plain_sums(spark, docs):
    """Score and verdict of every document, from buckets counted one by one."""
    own, n = pairs(docs), quality_rules.BUCKETS
    good = {d for d, _ in own if d is not None and d % 3 == 0}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in own]
    grams = [[spark_hash(1, x) % n for x in w] + [spark_hash(2, x, y) % n for x, y in zip(w, w[1:])] for w in split]
    raw, target = Counter(), Counter()
    for (d, _), own_grams in zip(own, grams):
        raw.update(own_grams)
        if d in good:
            target.update(own_grams)
    r, t = raw.total() + n, target.total() + n
    ratio = [math.log((target[k] + 1) / t) - math.log((raw[k] + 1) / r) for k in range(n)]
    want = {}
    for (d, _), w, own_grams in zip(own, split, grams):
        score = sum(ratio[k] for k in own_grams) / len(own_grams) if own_grams else None
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want[d] = (len(hit), failed, score, not failed and score >= quality_rules.THRESHOLD)
    trusted = spark.createDataFrame([(d,) for d in sorted(good)] + [(None,)], "doc_id bigint")
    for r in quality_rules.judge(docs, trusted).collect():
        hit, failed, score, kept = want[r.doc_id]
        assert (r.n_repeat_words, r.base_failed) == (hit, failed)
        assert r.score is None if score is None else abs(r.score - score) < 2e-6
        assert r.kept == kept or abs(score - quality_rules.THRESHOLD) < 2e-6


def readings(token):
    """Every reading of a token's lattice, with the cost of its changes."""
    for choice in product(*toxicity._options(token)):
        yield "".join(p for p, _ in choice), [p for p, _ in choice], sum(c for _, c in choice)


def language_cost(pieces, model):
    x, y, total = 27, 0, 0.0
    for piece in pieces:
        if piece == " ":
            total += model[x, y, 0]
            x, y = 0, 0
        for c in piece.strip(" "):
            z = ord(c) - 96 if "a" <= c <= "z" else 27
            total += model[x, y, z]
            x, y = y, z
    return total + model[x, y, 0]


def test_decoding_finds_the_cheapest_reading():
    r = np.random.default_rng(5)
    model = r.random((28, 28, 28)) * 6
    alphabet = list("abio013$!+x") + ["aaa", "\n"]
    for _ in range(300):
        token = "".join(r.choice(alphabet, int(r.integers(1, 7)))).strip("\n") or "a"
        token = re.sub("\n+", "\n", token)
        least = min(cost + language_cost(pieces, model) for _, pieces, cost in readings(token))
        got = toxicity.decode(token, model)
        assert abs(min(cost + language_cost(pieces, model) for text, pieces, cost in readings(token) if text == got) - least) < 1e-9


def test_a_very_long_token_is_decoded():
    model = np.full((28, 28, 28), 3.0)
    got = toxicity.decode("a1" * 40_000, model)
    assert len(got) == 80_000 and set(got[::2]) == {"a"}


def test_toxicity_scores_are_plain_sums(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int"), allowMissingColumns=True)
    clean = docs.select("doc_id", toxicity.text_of().alias("text"))
    model, kept, weights = toxicity.fit(clean, labels)
    restore, known = toxicity.Restorer(model), {int(k): w for k, w in zip(kept, weights)}
    one = lambda h: int(mix(np.array([h], np.uint64))[0]) & (toxicity.BUCKETS - 1)
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    want = []
    for d, t in pairs(docs):
        found = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", restore(t or "").encode().translate(lower)):
            found.add(one(hash_word(w)))
            for k in toxicity.PREFIXES:
                if len(w) > k:
                    found.add(one(hash_word(w[:k]) ^ int(toxicity._ODD[(k - 1) % len(toxicity._ODD)])))
        z = weights[-1] + sum(known.get(k, 0.0) for k in found)
        p = round(1 / (1 + math.exp(-max(-40, min(40, z)))), 6)
        want.append((str(d), d is not None and zlib.crc32(str(d).encode()) % 5 == 0, p))
    got = sorted((str(r.doc_id), r.held_out, r.score, r.predicted) for r in toxicity.score(docs, labels).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 and a[3] == int(a[2] >= 0.5)


def plain_rates(text):
    """The labellers' rates of one text, by plain counting."""
    data = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n = max(len(w), 1)
    symbols, marks = b"#*$%&<>!|", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
    lines = [tuple(x) for x in (re.findall(rb"[^\x20\x09-\x0D]+", line) for line in data.split(b"\n")) if x]
    return [
        sum(c in symbols and c != 124 for c in data) / n, upper / max(upper + lower, 1), sum(a == b for a, b in zip(w, w[1:])) / n, len(set(w)) / n, data.count(b"|") / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), sum(x[-1] in symbols for x in w) / n, sum(c in marks for c in data) / max(sum(c > 32 for c in data), 1), float(len(w)),
    ]


def test_rates_are_plain_counts(docs):
    texts = [t or "" for _, t in pairs(docs)]
    got = quality_classifier.rates(words(pa.array(texts, pa.large_string()), lower=False))
    assert np.allclose(got, np.array([plain_rates(t) for t in texts]))


def test_classifier_is_em_and_a_plain_scorer(docs):
    """Posteriors from expectation-maximisation over the documents one by one, and scores from features counted one by one."""
    own = pairs(docs)
    texts = [t or "" for _, t in own]
    clean = docs.select(quality_classifier.text_of().alias("text"))
    share, p, weights = quality_classifier.fit(clean)
    votes = quality_classifier.votes(np.array([plain_rates(t) for t in texts]))
    plain_share, plain_p = quality_classifier.em(votes, np.ones(len(votes)))
    assert abs(share - plain_share) < 1e-9 and np.allclose(p, plain_p)
    odds = []
    for v in votes:
        bad, good = math.log(share), math.log(1 - share)
        for j, said in enumerate(v):
            if said != quality_classifier.NONE:
                bad, good = bad + math.log(p[j, 0, said]), good + math.log(p[j, 1, said])
        odds.append(1 / (1 + math.exp(min(700, good - bad))))
    half = quality_classifier.BUCKETS // 2
    want = []
    for (d, _), t, q in zip(own, texts, odds):
        data, z = t.encode(), weights[-1]
        grams = Counter(((a * 65_599 + b) * 65_599 + c) * 2_654_435_761 >> 7 & (half - 1) for a, b, c in zip(data, data[1:], data[2:]))
        z += sum(weights[k] * np.float32(n / (len(data) - 2)) for k, n in grams.items())
        for j, rate in enumerate(plain_rates(t)[:8]):
            bin_ = sum(rate >= e for e in quality_classifier._EDGES)
            z += 0.5 * weights[half + (int(mix(np.array([j * 16 + bin_], np.uint64))[0]) & (half - 1))]
        want.append((str(d), q, 1 / (1 + math.exp(-z))))
    got = sorted((str(r.doc_id), r.posterior, r.score, r.kept) for r in quality_classifier.classify(docs).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 2e-6 and abs(a[2] - b[2]) < 1e-4 and a[3] == (a[2] < 0.5)


def test_training_holds_a_block_of_the_sample(spark):
    """Features of long texts go through the driver in blocks: its peak is far under their whole size, in one block or many."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(33, 500, 12_000))) for _ in range(300)]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8).cache()
    quality_classifier.fit(table)
    tracemalloc.start()
    _, _, weights = quality_classifier.fit(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(weights).sum() > 0
    assert peak < 40e6, peak


def test_training_in_blocks_is_full_batch(monkeypatch):
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 30, 40)
    at, x, target = rng.integers(0, quality_classifier.BUCKETS, sizes.sum()).astype(np.uint16), rng.random(sizes.sum(), np.float32), rng.random(40)
    whole = quality_classifier.train(sizes, at, x, target)
    for entries in (1, 50, 200):
        monkeypatch.setattr(quality_classifier, "ENTRIES", entries)
        assert np.allclose(quality_classifier.train(sizes, at, x, target), whole, rtol=0, atol=1e-9)


def test_a_worker_holds_a_small_block(spark, docs, monkeypatch):
    """What scoring holds beside Spark's batch is far under 40 bytes for each byte of the batch, and scores don't depend on blocks."""
    kernels, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: kernels.append(f) or real(self, f, *a, **k))
    rng = np.random.default_rng(7)
    model = 0.1, np.full((len(quality_classifier.LABELLERS), 2, 2), 0.5), rng.normal(size=quality_classifier.BUCKETS + 1)
    quality_classifier.classify(docs, model)
    texts = ["".join(map(chr, rng.integers(32, 127, 3000))) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(texts)], names=["doc_id", "text"])
    list(kernels[-1](iter([batch])))
    tracemalloc.start()
    got = [x for b in kernels[-1](iter([batch])) for x in b.column(2).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == np.round(quality_classifier._scores(pa.array(texts, pa.large_string()), *model)[1], 6).tolist()
    assert peak < 12e6, peak


def test_filter_sends_each_text_once(spark, docs):
    """Python gets the rows as they are, without a second copy of the text, wherever the column stands and however it is written."""
    for wide in (docs, docs.selectExpr("'x' source", "text Text", "doc_id", "1 a", "2 _text")):
        kept = quality_classifier.keep_good(wide)
        assert kept._jdf.queryExecution().analyzed().children().apply(0).output().size() == len(wide.columns)
        at = [c.lower() for c in wide.columns].index("text")
        want = sorted(map(str, (r.text for r in quality_classifier.classify(docs).join(docs, "doc_id").where("kept").collect())))
        got = sorted(str(r[at]) for r in kept.collect())
        extra = [str(t) for d, t in pairs(docs) if d is None and str(t) in got]
        assert got == sorted(want + extra) and kept.columns == wide.columns
