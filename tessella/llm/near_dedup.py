"""Near-duplicate detection with SetSketch registers, banding, joint likelihood, and exact verification.

1. Each text becomes its set of word shingles (64-bit hashes) and a sketch: for each of ``REGISTERS`` hash functions the
   minimum over the set, seen as an exponential variable h and stored as floor(1 - log_b h). Sketches of parts merge by
   the larger register, and two registers agree with a probability of the sets' similarity or a little more.
2. Texts with equal sets form one class, which goes on as one node; its id is the least xxhash64 of its texts.
3. Registers are cut into bands; representatives that agree in a band share a bucket. In a bucket each is linked with the two
   hubs (the least and the greatest id): no pairs within a group are made.
4. Candidate pairs whose likelihood, given both sizes and how many registers are larger, smaller or equal, peaks well under the
   threshold are dropped (``SLACK`` is over four standard errors); the rest are verified on the full sets.
5. Components of the verified links. What hubs may have left open are pairs of different components in a bucket of more than three. Such members
   get new hubs, one of their bucket's largest component and one of the rest, in each of ``HUB_ROUNDS`` rounds (fewer if one finds no link).
6. What is still open is compared exactly: in each bucket, the members that are not in its largest component with all members of other
   components whose set size allows a link, inside cells of two neighbouring classes of size and groups of two blocks of bounded size, each pair in the
   first band that it shares; groups give out members and links, never pairs.

A pair at the threshold itself misses all bands with probability (1 - 0.8 ** 4) ** 32, under 1e-7.

Null texts and texts without words have an empty set and are linked with nothing. Each row of the input is returned, also where
rows share a doc_id (their texts are compared like any others); a null doc_id never names a component that has another. Ties have no
part: components do not depend on the order of rows. A very long text is sketched in steps; its set is one array. An empty table gives no rows; other
columns are passed on by ``keep_first`` and not read elsewhere, so their names can't clash. Nodes are told apart by 64 bits: in 10**10 different texts, under three pairs share an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, free_name, keyed, materialize, table, text_of
from .components import components
from .textvec import U64, grams, mix, sequence_hash, words

REGISTERS, ROWS_IN_BAND, BASE = 128, 4, 1.02
SLACK = 0.15
#: Rounds of new hubs for open members.
HUB_ROUNDS = 1
#: Members and shingles of one block of a bucket.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2000, 2_000_000
#: Shingles sketched at once, so that memory does not grow with the text.
STEP = 8192

_random = np.random.default_rng(20240607)
_MULTIPLIER = (_random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADDEND = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    w = words(texts, "space")
    values, at = grams(w, size)
    cut = np.searchsorted(at, w.bounds)
    out = []
    for i in range(len(texts)):
        a, b = cut[i], cut[i + 1]
        if b > a:
            out.append(np.unique(values[a:b]))
        else:
            own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
            out.append(np.array([sequence_hash(own)] if len(own) else [], np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: uint16 registers of exponentially spaced truncated minima."""
    x = (shingles >> U64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), STEP):
        np.minimum(least, (x[None, a : a + STEP] * _MULTIPLIER + _ADDEND).min(axis=1), out=least)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)) + 256, 0, 65535).astype(np.uint16)


def likely_similarity(n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The similarity of greatest joint likelihood, given set sizes and how many registers of a are larger or smaller than b's."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    for share in np.linspace(0, 1, 51):
        j = share * most
        p1, p2 = p(u - v * j), p(v - u * j)
        value = larger * np.log(p1) + smaller * np.log(p2) + (REGISTERS - larger - smaller) * np.log(np.maximum(1 - p1 - p2, 1e-12))
        better = value > best
        best[better], at[better] = value[better], j[better]
    return at


_SIG = "doc_id bigint, h bigint, n_shingles bigint, k1 bigint, k2 bigint, sketch binary"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Set size, a 128-bit key of the whole set, and the sketch, for each row of ``docs`` (doc_id, text)."""

    def sign(batches):
        for batch, texts in blocks(batches):
            sets = shingle_sets(texts, size)
            some = [x if len(x) else None for x in sets]
            with np.errstate(over="ignore"):
                keys = [[None if x is None else int(mix(x ^ seed).sum(dtype=np.uint64).astype(np.int64)) for x in some] for seed in (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F))]
            sketches = [None if x is None else registers(x).tobytes() for x in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), *[pa.array(k, pa.int64()) for k in keys], pa.array(sketches, pa.binary())], names=["doc_id", "h", "n_shingles", "k1", "k2", "sketch"])

    return docs.mapInArrow(sign, _SIG)


def _bands(sketches: DataFrame) -> DataFrame:
    n = REGISTERS // ROWS_IN_BAND
    seeds = np.arange(n, dtype=np.uint64)

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, n)  # a band is 4 x 16 bits
            key = mix(mix(own + seeds) ^ seeds)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), *[pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), n)) for k in (0, 1)]], names=["key", "id", "n"])

    return sketches.select("id", "n", "sketch").mapInArrow(cut, "key bigint, id bigint, n bigint")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * intersection >= percent * union."""
    a = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def likely(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))
            j = likely_similarity(na, nb, (x > y).sum(axis=1), (x < y).sum(axis=1))
            yield batch.select([0, 1]).filter(pa.array(100 * (j + SLACK) >= percent))

    pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(likely, "a bigint, b bigint")
    pairs = materialize(pairs, "likely")

    def exact(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            size_a, size_b = (np.frombuffer(c.cast(pa.large_string()).buffers()[1], np.int64, len(c) + 1, c.offset * 8) for c in (left.cast(pa.large_string()), right.cast(pa.large_string())))
            at = 0
            while at < batch.num_rows:  # as many pairs as fit a block; a's repeat, so one set serves all of its pairs in a row
                end = at + 1
                while end < batch.num_rows and size_a[end + 1] - size_a[at] + size_b[end + 1] - size_b[at] < 1 << 20:
                    end += 1
                sets_a, sets_b = shingle_sets(left.slice(at, end - at), size), shingle_sets(right.slice(at, end - at), size)
                for k, (p, q) in enumerate(zip(sets_a, sets_b)):
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    keep[at + k] = 100 * shared >= percent * (len(p) + len(q) - shared)
                at = end
            yield batch.select([0, 1]).filter(pa.array(keep))

    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return materialize(pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(exact, "a bigint, b bigint"), "links")


_GROUP = "key bigint, cell int, i int, j int, id bigint, n bigint, c bigint, block int, sketch binary"


def _size_class(n, percent: int):
    """Sets whose classes differ by more than one can't be linked."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int32)


def _open_pairs(t: pa.Table, percent: int):
    """Pairs of rows of one group, across its two blocks, that may be links between components: the likeliest first."""
    n, c, block = (t.column(k).to_numpy() for k in ("n", "c", "block"))
    own = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    bands = own.view(np.uint64)
    i, j, key, cell = (t.column(k)[0].as_py() for k in ("i", "j", "key", "cell"))
    size = _size_class(n, percent)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found = []
    seeds = np.arange(bands.shape[1], dtype=np.uint64)
    keys = mix(mix(bands + seeds) ^ seeds)
    band = int(np.flatnonzero((keys == np.int64(key).astype(np.uint64)).any(axis=0))[0])
    for x in left.tolist():
        y = right[right > x] if i == j else right
        y = y[(c[y] != c[x]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (np.minimum(size[x], size[y]) == cell)]
        if not len(y):
            continue
        y = y[(bands[y] == bands[x]).argmax(axis=1) == band]
        y = y[(own[y] == own[x]).sum(axis=1) * 200 >= percent * REGISTERS]
        if len(y):
            found.append(np.stack([np.full(len(y), x), y]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    likely = np.zeros(pairs.shape[1])
    for k in range(0, pairs.shape[1], 20_000):
        x, y = pairs[:, k : k + 20_000]
        likely[k : k + 20_000] = likely_similarity(n[x].astype(float), n[y].astype(float), (own[x] > own[y]).sum(axis=1), (own[x] < own[y]).sum(axis=1))
    order = np.argsort(-likely, kind="stable")
    return pairs[:, order[100 * (likely[order] + SLACK) >= percent]].T


def _open(shared: DataFrame, label: DataFrame) -> DataFrame:
    """key, id, n, c and top of the members of buckets that hubs may have left open; c is the component, top the bucket's largest."""
    named = shared.where("size > 3").select("key", "id", "n").join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    each = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    top = each.groupBy("key").agg(F.max(F.struct("m", "c")).alias("t"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", F.col("t.c").alias("top"))
    return materialize(named.join(top, "key"), "open")


def _new_hubs(open_: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs (a, b): each member outside its bucket's largest component with a hub in it and one outside, where these are of another component."""
    order = F.struct(F.xxhash64("id", F.lit(seed)).alias("order"), "id", "c", "n")
    outside = F.col("c") != F.col("top")
    hubs = open_.groupBy("key").agg(F.min(F.when(outside, order)).alias("x"), F.min(F.when(~outside, order)).alias("y"))
    pairs = open_.where(outside).join(hubs, "key").select("id", "c", "n", F.explode(F.array("x", "y")).alias("hub"))
    close = 100 * F.least("n", F.col("hub.n")) >= percent * F.greatest("n", F.col("hub.n"))
    return pairs.where((F.col("c") != F.col("hub.c")) & close).select(F.least("id", F.col("hub.id")).alias("a"), F.greatest("id", F.col("hub.id")).alias("b")).distinct()


def _across(open_: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links between open members of one bucket that belong to different components."""

    def blocks_for(m, s):
        return F.ceil(F.greatest(m / BLOCK_MEMBERS, s / BLOCK_SHINGLES)).cast("int")

    # a pair of sizes that allow a link is compared in the cell of the smaller one's class
    own = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent) + 1e-9).cast("int")
    cells = open_.withColumn("own", own).withColumn("cell", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    outside = F.col("c") != F.col("top")

    def sums(of, x):
        return F.sum(F.when(of, F.lit(x) if isinstance(x, int) else F.col(x)).otherwise(0))

    sizes = cells.groupBy("key", "cell").agg(blocks_for(sums(outside, 1), sums(outside, "n")).alias("rest"), blocks_for(sums(~outside, 1), sums(~outside, "n")).alias("main"), F.min("own").alias("least"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    sizes = sizes.where("rest > 0 AND least = cell AND c0 <> c1").select("key", "cell", "rest", "main")
    mixed = cells.join(sizes, ["key", "cell"])
    place = F.xxhash64("id")
    mixed = mixed.withColumn("block", F.when(outside, F.pmod(place, "rest")).otherwise(F.col("rest") + F.pmod(place, F.greatest("main", F.lit(1)))).cast("int"))
    mixed = mixed.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("rest") + F.col("main") - 1).otherwise(F.col("rest") - 1))))
    mixed = mixed.select("key", "cell", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "id", "n", "c", "block")
    mixed = mixed.join(classes.select("id", "sketch"), "id").select("key", "cell", "i", "j", "id", "n", "c", "block", "sketch")

    def open_members(t: pa.Table) -> pa.Table:
        return t.take(pa.array(np.unique(_open_pairs(t, percent))))

    hopeful = materialize(mixed.groupBy("key", "cell", "i", "j").applyInArrow(open_members, _GROUP), "hopeful")

    def link(t: pa.Table) -> pa.Table:
        ids, c = t.column("id").to_pylist(), t.column("c").to_pylist()
        sets = [x for k in range(0, t.num_rows, 64) for x in shingle_sets(t.column("text").slice(k, 64).combine_chunks(), size)]
        root = {x: x for x in c}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for x, y in _open_pairs(t, percent).tolist():
            a, b = find(c[x]), find(c[y])
            if a != b:
                shared_ = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * shared_ >= percent * (len(sets[x]) + len(sets[y]) - shared_):
                    root[a] = b
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return materialize(hopeful.join(texts, "id").select("key", "cell", "i", "j", "id", "n", "c", "block", "sketch", "text").groupBy("key", "cell", "i", "j").applyInArrow(link, "a bigint, b bigint"), "across")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components when ``links`` (a, b) are added to those that ``label`` names; its stars stand for all links before, and take few rounds."""
    return components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def _found(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): h (the hash of its text), n_shingles, node (null for an empty set) and component_id.

    Rows have the same node if they are of one component; a component_id may be that of several components, where rows share a doc_id.
    """
    docs = keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    sig = materialize(signatures(docs, size), "signatures")
    classes = sig.where("k1 is not null").groupBy("k1", "k2").agg(F.min("h").alias("id"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    bands = _bands(classes)
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("size > 1")
    shared = materialize(bands.join(buckets, "key"), "bands")
    hubs = shared.select("id", F.explode(F.array("lo", "hi")).alias("hub")).where("id <> hub")
    tested = materialize(hubs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs")
    in_buckets = shared.select("id").distinct()
    texts = docs.select(F.col("h").alias("id"), "text").join(in_buckets, "id", "left_semi").dropDuplicates(["id"])
    links = _verified(tested, classes, texts, size, percent)
    label = components(links)
    for seed in range(HUB_ROUNDS):
        open_ = _open(shared, label)
        new = _verified(_new_hubs(open_, seed, percent).join(tested, ["a", "b"], "left_anti"), classes, texts, size, percent)
        if not new.limit(1).count():
            break
        label = _joined(label, new)
    else:
        open_ = _open(shared, label)
    across = _across(open_, classes, texts, size, percent)
    if across.limit(1).count():
        label = _joined(label, across)
    named = classes.select("k1", "k2", "id", "least").join(label.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", "least", F.coalesce("component", "id").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    nodes = named.join(least, "c").select("k1", "k2", F.col("c").alias("node"), "component_id")
    return sig.select("doc_id", "h", "n_shingles", "k1", "k2").join(nodes, ["k1", "k2"], "left").select("doc_id", "h", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n_shingles and component_id, the least doc_id that it can reach."""
    return _found(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with all its columns, and all rows without words, which are copies of nothing.

    It is the row with the least doc_id (a null one is the last), then the least hash of its text. Rows are told apart by both, so
    different texts under one or no doc_id are kept or dropped each for itself; of rows that have both in common one is left.
    """
    key, own = free_name(docs, "_id"), free_name(docs, "_h")
    found = materialize(_found(docs, size, percent).groupBy("node", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "n")).alias("x")
    firsts = found.where("node is not null").groupBy("node").agg(first).select("x.doc_id", "x.h", (F.col("x.n") > 1).alias("again"))
    firsts = firsts.unionByName(found.where("node is null").select("doc_id", "h", F.lit(False).alias("again")))
    firsts = materialize(firsts.select(F.col("doc_id").alias(key), F.col("h").alias(own), "again"), "firsts")
    names = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.select(*names, F.col("doc_id").cast("bigint").alias(key), F.xxhash64(text_of()).alias(own))

    def rows_of(kept: DataFrame) -> DataFrame:
        kept = kept.select(F.col(key).alias("_a"), F.col(own).alias("_b"))
        return docs.join(kept, docs[key].eqNullSafe(kept["_a"]) & (docs[own] == kept["_b"]), "left_semi")

    left = rows_of(firsts.where("not again"))
    again = firsts.where("again")
    if again.limit(1).count():
        left = left.unionByName(rows_of(again).dropDuplicates([key, own]))
    return left.select(*names)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a similarity of 0.8 or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
