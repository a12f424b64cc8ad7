"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Every text is searched for three base kinds (leftmost, non-overlapping within a kind) and for random-looking tokens.
Candidates are hashed, and the corpus counts by how many owners, in how many repositories and in how many different texts each hash occurs:

* a widely copied value is an example;
* any other that looks random is a live credential.

Both counts decide what is widely copied, and whole copies of a text count once: ``COPIED_OWNERS`` owners or ``COPIED_REPOSITORIES`` repositories, and as many
different texts. So a placeholder all over one source is an example, and a secret that a copied document took to a second source is not.

Base spans are always reported, with that verdict; a random-looking token is added (kind ``owned``) only if it is live and touches no base span.

Counting goes by (hash, owner, repository, text), then by fewer of these, then by hash: each step is combined before its shuffle, so a value that
a third of all rows hold is spread over its owners and repositories first. The counts come back to the spans by a join on the hash; those of
hashes that ``HOT_ROWS`` spans or more have, few by that bound, are broadcast. Documents themselves are never shuffled.

Null texts are empty. A null owner or repository counts as one unnamed owner or repository. Repeated rows are
scanned each and count as one repository. Rows without a doc_id are scanned like others. In a very long text every match is found; places are added
up by chunks. Spans that begin at one place are in the order of their kinds. Spans are in code points, the end exclusive; a span is the whole match.
An empty table gives no rows. ``redact`` passes columns of any name on as they are; the rest reads only what it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, keyed, materialize, table, text_of

# The kinds in their order, their patterns, the group that is the value, and its least length.
KINDS = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # a run is taken whole or not at all, so the length can stand in the pattern
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Distinct characters that a random-looking value has at least.
DISTINCT = 10
#: Owners, or else repositories, from which on a value is widely copied.
COPIED_OWNERS, COPIED_REPOSITORIES = 5, 100
#: Spans from which on the counts of a hash are broadcast: at most one hash in so many spans.
HOT_ROWS = 100_000
#: Matches of one text whose places are found together.
CHUNK = 256


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")


def _chunks(rows: Column) -> Column:
    """The array cut into arrays of at most ``CHUNK``; one empty array if there is nothing."""
    last = F.greatest(F.floor((F.size(rows) + (CHUNK - 1)) / CHUNK).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda k: F.slice(rows, (k - 1) * CHUNK + 1, F.lit(CHUNK)))


def _placed(rows: Column, kind: str, rank: int) -> Column:
    """Spans of the matches. Lengths are added up by chunks first, so that no array grows by copies of more than a chunk."""

    def add(acc: Column, chunk: Column) -> Column:
        width = F.aggregate(chunk, F.lit(0), lambda n, x: n + F.length(x["b"]) + F.length(x["f"]))
        return F.struct((acc["at"] + width).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x["f"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def place(chunk: Column, head: Column) -> Column:
        return F.aggregate(chunk, F.struct(head.alias("at"), _none().alias("out")), step)["out"]

    heads = F.aggregate(_chunks(rows), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add)["out"]
    return F.flatten(F.zip_with(_chunks(rows), heads, place))


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """array<struct<start, rank, end, kind, value>>; only texts that match pay for the positions."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(found.alias("f"), F.slice(between, 1, F.size(found)).alias("b"), values.alias("v"))
    # the rows as the only item of an array, so that the nested functions share one evaluation of the patterns
    spans = F.flatten(F.transform(F.array(rows), lambda r: _placed(r, kind, rank)))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(spans, lambda s: F.length(s["value"]) >= least)).otherwise(_none())


def _random_looking(value: Column) -> Column:
    mixed = F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]"))
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def _touch(b: Column, first: Column, last: Column) -> Column:
    return (b["start"] < last["end"]) & (first["start"] < b["end"])


def _untouched(tokens: Column) -> Column:
    """Of a chunk of tokens in order, those that touch no base span; each is compared with the spans near the chunk only."""
    near = F.filter("base", lambda b: _touch(b, F.get(tokens, F.lit(0)), F.element_at(tokens, -1)))
    free = F.transform(F.array(near), lambda n: F.filter(tokens, lambda t: ~F.exists(n, lambda b: _touch(b, t, t))))
    return F.when(F.size(tokens) > 0, F.flatten(free)).otherwise(_none())


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """_row, doc_id, owner, repository, text_h (the hash of the text) and spans: base matches, and random-looking tokens that touch none of them."""
    own = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((owner, "owner"), (repository, "repository"))]
    scan = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint"), *own, text_of().alias("_text"))
    names = ["_row", "doc_id", "owner", "repository", "text_h"]
    scan = scan.withColumn("text_h", F.xxhash64("_text"))
    base = F.concat(*[_matches(F.col("_text"), *k, rank) for rank, k in enumerate(KINDS)])
    tokens = _matches(F.col("_text"), "owned", TOKEN, 0, 20, len(KINDS))
    scan = scan.select(*names, base.alias("base"), tokens.alias("tokens"))
    likely = F.array(F.filter("tokens", lambda t: _random_looking(t["value"])))  # one item, evaluated once
    free = F.flatten(F.transform(likely, lambda t: F.flatten(F.transform(_chunks(t), _untouched))))
    return scan.select(*names, F.concat("base", free).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """h, n_rows, n_owners, n_repositories, n_texts: how the corpus holds each candidate hash; ``found`` has h, owner, repository, text_h."""
    once = found.groupBy("h", "owner", "repository", "text_h").agg(F.count(F.lit(1)).alias("n"))
    owners = once.groupBy("h", "owner", "repository").agg(F.sum("n").alias("n")).groupBy("h", "owner").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    texts = once.groupBy("h", "text_h").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n_texts"))
    return owners.groupBy("h").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_owners"), F.sum("k").alias("n_repositories")).join(texts, "h")


_COUNTS = ("n_owners", "n_repositories", "n_texts")
_VERDICTS = "array<struct<start:int,rank:int,end:int,kind:string,verdict:string,n_owners:bigint,n_repositories:bigint,n_texts:bigint>>"


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` with the counts of their hash."""
    counts = materialize(ownership(rows), "counts")
    hot = counts.where(F.col("n_rows") >= HOT_ROWS)
    side = hot.select("h", *_COUNTS)
    if not hot.limit(1).count():
        return rows.join(counts.select("h", *_COUNTS), "h")
    cold = rows.join(F.broadcast(side.select("h")), "h", "left_anti").join(counts.where(F.col("n_rows") < HOT_ROWS).select("h", *_COUNTS), "h")
    return rows.join(F.broadcast(side), "h").unionByName(cold)


def secret_spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = COPIED_OWNERS, repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """For each row of ``docs``: doc_id, text_h and spans, array<struct<start, rank, end, kind, verdict, and the counts>> in order.

    verdict: ``example`` (widely copied), ``live`` (looks random) or ``owner-specific`` (the rest).
    """
    scan = materialize(candidates(docs, owner, repository), "candidates")
    rows = scan.where(F.size("spans") > 0).select("_row", "doc_id", "owner", "repository", "text_h", F.explode("spans").alias("s")).withColumn("h", F.xxhash64("s.value"))
    wide = (F.least("n_owners", "n_texts") >= owners) | (F.least("n_repositories", "n_texts") >= repositories)
    verdict = F.when(wide, "example").when(_random_looking(F.col("s.value")), "live").otherwise("owner-specific")
    judged = _counted(rows).withColumn("verdict", verdict).where((F.col("s.kind") != "owned") | (F.col("verdict") == "live"))
    span = F.struct("s.start", "s.rank", "s.end", "s.kind", "verdict", *_COUNTS)
    some = judged.groupBy("_row", "doc_id", "text_h").agg(F.sort_array(F.collect_list(span)).alias("spans")).select("_row", "doc_id", "text_h", F.col("spans").cast(_VERDICTS).alias("spans"))
    # texts whose only candidates were tokens that came to nothing, and those without any
    none = scan.select("_row", "doc_id", "text_h").join(some.select("_row"), "_row", "left_anti").select("doc_id", "text_h", F.array().cast(_VERDICTS).alias("spans"))
    return some.select("doc_id", "text_h", "spans").unionByName(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(field: str, value: str) -> Column:
    return F.size(F.filter("spans", lambda s: s[field] == value)).cast("bigint").alias(f"n_{value}")


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mark: str = "[SECRET]", owners: int = COPIED_OWNERS, repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """``docs`` with every span that is not a widely copied example replaced by ``mark``, and n_chars to match.

    Only texts that may hold a secret are joined with their spans (by doc_id and text); the others pass as they are.
    Rows that share a doc_id are redacted each at the spans of its own text.
    """
    key, same, own = free_name(docs, "_id"), free_name(docs, "_same"), free_name(docs, "_spans")
    may = F.lit(False)
    for pattern in (*(k[1] for k in KINDS), TOKEN):
        may = may | F.regexp_like(text_of(), F.lit(pattern))
    found = secret_spans(docs.where(may), owner, repository, owners, repositories).select("doc_id", "text_h", F.filter("spans", lambda s: s["verdict"] != "example").alias("spans"))
    found = found.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias(key), F.col("text_h").alias(same)).agg(F.first("spans").alias(own))
    hold = docs.where(may).join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64(text_of()) == F.col(same)), "left")
    # each step appends what lies before the next span, unless that begins inside the last one
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, piece).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(F.aggregate(own, begin, step, finish))
    cols = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    done = hold.select(*cols)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~may).unionByName(done)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, a document its repository. held_by has owners/repositories/texts of each span."""
    found = secret_spans(keyed(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["kind"] != "owned")
    number = [_count("kind", k[0]) for k in KINDS]
    verdict = [_count("verdict", v) for v in ("live", "example")]
    held = F.array_join(F.transform("spans", lambda s: F.concat_ws("/", *[s[c].cast("string") for c in _COUNTS])), ",")
    return found.select("doc_id", *number, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *verdict, held.alias("held_by"))


def _duck_spans(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, text, t.i AS i, '{kind}' AS kind, {rank} AS rank, v[t.i] AS value,
         CAST(list_sum(list_transform(b[1:t.i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:t.i - 1], lambda x: length(x))), 0) AS INTEGER) AS s,
         length(f[t.i]) AS n
  FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{p}', 0) AS f,
               regexp_extract_all(coalesce(text, ''), '{p}', {group}) AS v, string_split_regex(coalesce(text, ''), '{p}') AS b
        FROM documents WHERE regexp_matches(coalesce(text, ''), '{p}')) m, range(1, len(f) + 1) t(i)
  WHERE length(v[t.i]) >= {least}"""


_LOOKS = f"regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {DISTINCT}"
ORACLE = f"""
WITH base AS ({" UNION ALL ".join(_duck_spans(*k, rank) for rank, k in enumerate(KINDS))}),
token AS ({_duck_spans("owned", TOKEN, 0, 20, len(KINDS))}),
free AS (SELECT * FROM token t WHERE {_LOOKS} AND NOT EXISTS
  (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.s < t.s + t.n AND t.s < b.s + b.n)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM free),
owners AS (SELECT value, count(DISTINCT source) AS n_owners, count(DISTINCT (source, doc_id)) AS n_repositories, count(DISTINCT text) AS n_texts FROM every GROUP BY value),
judged AS (SELECT e.doc_id, e.kind, e.rank, e.s, e.n, n_owners || '/' || n_repositories || '/' || n_texts AS held,
    CASE WHEN least(n_owners, n_texts) >= {COPIED_OWNERS} OR least(n_repositories, n_texts) >= {COPIED_REPOSITORIES} THEN 'example' WHEN {_LOOKS.replace("value", "e.value")} THEN 'live' ELSE 'owner-specific' END AS verdict
  FROM every e JOIN owners USING (value)),
kept AS (SELECT *, kind || ':' || s || ':' || (s + n) AS name FROM judged WHERE kind <> 'owned' OR verdict = 'live'),
sums AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(name, ',' ORDER BY s, rank) FILTER (WHERE kind <> 'owned') AS base,
    string_agg(name, ',' ORDER BY s, rank) AS spans, string_agg(held, ',' ORDER BY s, rank) AS held_by, count(*) FILTER (WHERE verdict = 'live') AS n_live,
    count(*) FILTER (WHERE verdict = 'example') AS n_example FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(held_by, '') AS held_by
FROM documents d LEFT JOIN sums USING (doc_id)
"""
