"""Cross-entropy difference of matched n-gram models.

Over all words of the corpus, a target model (trusted texts) and a background model (all texts) of the same order and smoothing are counted:
unigrams, and pairs of a word and the one before it. A token's loss is -log p(word | word before), where the pair count is smoothed by
``WEIGHT`` unigram observations (unigrams have one added to each count); the first word's context is the start of the text. A text's score
is the mean over its tokens of target loss minus background loss: the lower, the more it looks like the target.

Every word and every pair has its own count, so the models grow with the corpus: there is no largest vocabulary, no unknown word and no
bucket that pairs share. Words and pairs are told apart by 64-bit hashes. The steps:

1. ``coded``: texts are gathered in blocks of about ``BLOCK_TOKENS`` tokens; a block is one row with its distinct words and each
   token's place among them. It is written, so blocks are the same for all that follows.
2. Each block sends what it counted, once for each distinct word and pair however often it occurs there, to the key range that the hash falls
   into. A range is a packed row of sorted hashes and counts; there are as many ranges as keep each at about ``RANGE_ENTRIES`` entries.
3. Each range adds up its blocks' counts and answers each block with the sums for what that block asked, in the same order.
4. Each block joins the answers and scores its texts.

A frequent word or pair is one entry of a block, so it makes no range hot; a task holds one block or one range. A text longer than a block is a
block of its own: memory grows with the longest text, not with the corpus.

Null and empty texts have no tokens and null losses. Repeated rows are counted and scored each; labels of one doc_id count once, the greatest.
Rows without a doc_id are counted in the background and scored. Ties have no part: a score depends on counts alone. Without target texts the
target model is uniform. An empty table gives no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, keyed, materialize, table, text_of
from .textvec import _ODD, U64, mix, words
from .vectors import with_labels

WEIGHT = 5.0
#: Tokens from which on a block is closed, and entries of a key range, about.
BLOCK_TOKENS, RANGE_ENTRIES = 1 << 20, 1 << 20
#: The context of a text's first word.
START = U64(0x7E55E11A0C0FFEE1)
#: What a block counts, each in its own half of the key ranges.
WORDS, PAIRS = 0, 1


def _key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) * _ODD[1] + word)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, the bytes of one place next to each other, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=U64(0))


_CODED = "block bigint, n_tokens bigint, doc_ids array<bigint>, sizes binary, labels binary, words binary, tokens binary"


def coded(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, _label) in blocks: their ids, numbers of tokens and labels, the block's words (ascending) and each token's word."""

    def run(batches):
        made, n, held = 0, 0, []

        def close():
            ids, hashes, sizes, labels = zip(*held)
            known, at = np.unique(np.concatenate(hashes), return_inverse=True)
            block = TaskContext.get().partitionId() << 32 | made
            binary = [packed(x) for x in (np.concatenate(sizes).astype(np.uint32), np.concatenate(labels).astype(np.uint8), _gaps(known), at.astype(np.uint32))]
            columns = [pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([[x for part in ids for x in part]], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in binary]]
            return pa.RecordBatch.from_arrays(columns, names=["block", "n_tokens", "doc_ids", "sizes", "labels", "words", "tokens"])

        for batch, texts in blocks(batches):
            w = words(texts)
            good = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False) == 1
            held.append((batch.column(0).to_pylist(), w.hashes, np.diff(w.bounds), good))
            n += len(w.hashes)
            if n >= block_tokens:
                yield close()
                made, n, held = made + 1, 0, []
        if held:
            yield close()

    return docs.select("doc_id", "text", "_label").mapInArrow(run, _CODED)


class Block:
    """What a row of ``coded`` says of its tokens."""

    def __init__(self, row: dict):
        self.known = np.cumsum(unpacked(row["words"], np.uint64), dtype=np.uint64)
        self.at = unpacked(row["tokens"], np.uint32)
        self.sizes = unpacked(row["sizes"], np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.good = unpacked(row["labels"], np.uint8)[self.doc] == 1
        ends = np.cumsum(self.sizes)
        first = (ends - self.sizes)[self.sizes > 0]
        # a context is one of the block's words, or the start, which stands after them
        self.context = np.empty(len(self.at), np.int64)
        self.context[1:] = self.at[:-1]
        self.context[first] = len(self.known)

    def contexts(self) -> np.ndarray:
        """The hashes of the words and of the start."""
        return np.append(self.known, START)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs' keys, ascending, and which of them each token has."""
        keys, at = np.unique(_key(self.contexts()[self.context], self.known[self.at]), return_inverse=True)
        return keys, at.ravel()

    def word_counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hashes, ascending, and their counts: as a word in all texts and in the target, as a context in both."""
        n = len(self.known) + 1
        counts = [np.bincount(x, w, n) for x in (self.at, self.context) for w in (None, self.good)]
        order = np.argsort(self.contexts(), kind="stable")
        return self.contexts()[order], [c[order] for c in counts]

    def pair_counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, at = self.pairs()
        return keys, [np.bincount(at, w, len(keys)) for w in (None, self.good)]


_SENT = "kind int, part bigint, block bigint, keys binary, counts binary"
_ANSWER = "kind int, part bigint, block bigint, counts binary, distinct bigint, n bigint, t bigint"


def _sent(blocks_: DataFrame, bits: int) -> DataFrame:
    """What each block counted, by key range: the ``bits`` highest bits of the hash."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                if not len(b.at):
                    continue
                for kind, (keys, counts) in ((WORDS, b.word_counts()), (PAIRS, b.pair_counts())):
                    part = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    cut = np.flatnonzero(np.diff(part, prepend=-1))
                    table_ = np.stack(counts, axis=1).astype(np.uint32)
                    rows = [(kind, int(part[i]), row["block"], packed(_gaps(keys[i:j])), packed(table_[i:j].T.ravel())) for i, j in zip(cut, [*cut[1:], len(keys)])]
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    for a in range(0, len(rows), 1000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 1000]), kinds)], names=["kind", "part", "block", "keys", "counts"])

    return blocks_.mapInArrow(run, _SENT)


def _answered(t: pa.Table) -> pa.Table:
    """The sums of one key range: for each block the counts of its keys, in their order; with the first, what the range holds in all."""
    keys = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()]
    counts = [unpacked(x, np.uint32).reshape(-1, len(k)) for x, k in zip(t.column("counts").to_pylist(), keys)]
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    at = at.ravel()
    sums = [np.bincount(at, c, len(known)).astype(np.uint64) for c in np.concatenate(counts, axis=1)]
    cut = np.cumsum([0, *map(len, keys)])
    back = [packed(np.stack([s[at[a:b]] for s in sums]).ravel()) for a, b in zip(cut, cut[1:])]
    total = [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())]
    rest = [pa.array([x] + [0] * (len(keys) - 1), pa.int64()) for x in total]
    return pa.table([t.column("kind"), t.column("part"), t.column("block"), pa.array(back, pa.binary()), *rest], names=["kind", "part", "block", "counts", "distinct", "n", "t"])


_SCORES = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


def score(docs: DataFrame, trusted: DataFrame, block_tokens: int = BLOCK_TOKENS, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_tokens, target_loss, background_loss and score; ``trusted`` has doc_id, quality."""
    docs = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    blocks_ = materialize(coded(with_labels(docs, trusted, "quality"), block_tokens), "blocks")
    n_tokens = blocks_.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(0, int(n_tokens // range_entries).bit_length())
    answers = materialize(_sent(blocks_, bits).groupBy("kind", "part").applyInArrow(_answered, _ANSWER), "answers")
    s = answers.where(F.col("kind") == WORDS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "n", "t")]).first()
    all_n, all_t = float(s.n + s.distinct), float(s.t + s.distinct)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Block(row)
            losses = [np.full(len(b.sizes), np.nan)] * 2
            if len(b.at):
                back: dict[int, np.ndarray] = {}
                for kind, width in ((WORDS, 4), (PAIRS, 2)):
                    own = sorted((p, c) for k, p, c in zip(*(right.column(x).to_pylist() for x in ("kind", "part", "counts"))) if k == kind)
                    back[kind] = np.concatenate([unpacked(c, np.uint64).reshape(width, -1) for _, c in own], axis=1).astype(np.float64)
                order = np.argsort(b.contexts(), kind="stable")
                by_word = np.empty_like(back[WORDS])
                by_word[:, order] = back[WORDS]
                at = b.pairs()[1]
                some = np.flatnonzero(b.sizes > 0)
                begin = (np.cumsum(b.sizes) - b.sizes)[some]
                losses = []
                for total, word, context, pair in ((all_t, by_word[1], by_word[3], back[PAIRS][1]), (all_n, by_word[0], by_word[2], back[PAIRS][0])):
                    loss = -np.log((pair[at] + WEIGHT * ((word[b.at] + 1) / total)) / (context[b.context] + WEIGHT))
                    mean = np.full(len(b.sizes), np.nan)
                    mean[some] = np.add.reduceat(loss, begin) / b.sizes[some]
                    losses.append(mean)
            values = [*losses, losses[0] - losses[1]]
            none = np.isnan(losses[0])
            out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(b.sizes), *[pa.array(np.round(x, 6), pa.float64(), mask=none) for x in values]], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"]))
        empty = pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), *[pa.float64()] * 3)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
        return pa.concat_tables(out) if out else empty

    answers = answers.select("kind", "part", "block", "counts")
    return blocks_.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, _SCORES)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, n) of every word of the corpus; ``docs`` has text."""

    def run(batches):
        for _, texts in blocks(batches):
            known, n = np.unique(words(texts).hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target are the documents labelled as good."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Words as ``words`` splits them, losses as defined above; pairs by the words themselves.
ORACLE = f"""
WITH text AS (SELECT row_number() OVER () AS r, doc_id, coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id), 0) = 1 AS good,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents d),
token AS (SELECT r, good, w[i] AS word, w[i - 1] AS before FROM (SELECT r, good, w, unnest(range(1, len(w) + 1)) AS i FROM text)),
word AS (SELECT word, count(*) AS n, count(*) FILTER (WHERE good) AS t FROM token GROUP BY word),
context AS (SELECT before, count(*) AS n, count(*) FILTER (WHERE good) AS t FROM token GROUP BY before),
pair AS (SELECT before, word, count(*) AS n, count(*) FILTER (WHERE good) AS t FROM token GROUP BY before, word),
total AS (SELECT sum(n) + count(*) AS n, sum(t) + count(*) AS t FROM word),
priced AS (SELECT p.before, p.word, -ln((p.t + {WEIGHT} * ((w.t + 1) / s.t)) / (c.t + {WEIGHT})) AS target, -ln((p.n + {WEIGHT} * ((w.n + 1) / s.n)) / (c.n + {WEIGHT})) AS background
  FROM pair p JOIN word w USING (word) JOIN context c ON c.before IS NOT DISTINCT FROM p.before, total s),
mean AS (SELECT r, avg(target) AS target, avg(background) AS background FROM token k JOIN priced p ON p.word = k.word AND p.before IS NOT DISTINCT FROM k.before GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(target, 6) AS target_loss, round(background, 6) AS background_loss, round(target - background, 6) AS score FROM text LEFT JOIN mean USING (r)
"""
