"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of a text. Every window contains phrases of ``PHRASE``
words, of which the one with the least hash is its anchor; equal windows have equal anchors, so
only anchors (about a seventh of the positions) have to be compared over all documents:

1. Confirm: tasks hash the anchors of their texts. What recurs within a task is confirmed there;
   otherwise one place a hash is dealt out by hash, and of hashes with several places the least
   one's text cuts the phrase out. Either way a text gets the words of the recurring phrases that
   it holds, not where they stand.
2. Locate: each shard of texts compiles the phrases that it got into Aho-Corasick automata of at
   most ``max_phrases`` each and streams its texts through them, which finds every occurrence,
   word for word. A shard is bounded by its texts' bytes and its phrases.
3. Judge: windows around located anchors are compared by 128 bits of hash. A task keeps the first
   of the equal windows it has and settles the others itself; the first ones are dealt out by
   anchor, the earliest (document, start) stays and the others are removed.

Texts are made distinct first and written as a table bucketed by text, so they are shuffled once
whatever is joined to them. All windows of a later copy start earlier in the first one.

Cases: a null text has no words; a null identifier is smaller than every other; texts of fewer
than ``WINDOW`` words lose nothing; rows that repeat identifier and text get the same result and
are not earlier than each other, nor are different texts under one identifier; texts of any length
are handled whole, alone in a shard if they are long; an empty table gives an empty result;
further columns, whatever their names, are left out of the result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.words import hashes, mix
from cairn.session import arrow_batches, materialise, partition_keys, shared_dir

WINDOW, PHRASE = 20, 8
REACH = WINDOW - PHRASE + 1  # phrases in a window
NULL_ID = -(1 << 63)
FAR = np.uint64((1 << 64) - 1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
PHRASE_MULT, WINDOW_MULT = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over every ``size`` neighbours."""
    n, span = len(x) - size + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * span <= size:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[:n], x[size - span : size - span + n])


class Words:
    """The words of several texts, their hashes, phrases, windows and anchors."""

    def __init__(self, texts: list[str | None]):
        raws = [b"" if t is None else t.encode("utf-8") for t in texts]
        self.whole = b"\n".join([*raws, b""])
        whole = np.frombuffer(self.whole, np.uint8)
        mask = np.concatenate([[False], ~IS_SPACE[whole], [False]])
        change = np.flatnonzero(mask[1:] != mask[:-1])
        self.starts, self.lengths = change[::2], change[1::2] - change[::2]
        edges = np.cumsum([0, *[len(r) + 1 for r in raws]])
        #: Where each text's words begin, and one more.
        self.first = np.searchsorted(self.starts, edges)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.raws = raws
        self.hash = hashes(whole, self.starts, self.lengths)
        self.phrase = self._rolling(PHRASE, PHRASE_MULT, FAR)
        least = sliding(self.phrase, REACH, np.minimum)
        self.windows = len(least)
        self.valid = self.doc[: self.windows] == self.doc[WINDOW - 1 :] if self.windows > 0 else np.zeros(0, bool)
        self.least = least

    def _rolling(self, size: int, mult: int, invalid) -> np.ndarray:
        """Hashes of ``size`` words from each word on; ``invalid`` where a text ends before."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.uint64)
        up, down = (np.full(n, x, np.uint64) for x in (mult, pow(mult, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * up, dtype=np.uint64)])
        out = mix((total[size:] - total[:-size]) * down[: n - size + 1])
        return np.where(self.doc[: n - size + 1] == self.doc[size - 1 :], np.minimum(out, FAR - np.uint64(1)), invalid)

    def anchors(self) -> np.ndarray:
        """Positions of the phrases that are the anchor of some window."""
        if not self.valid.any():
            return np.zeros(0, np.int64)
        inside = np.where(self.valid, self.least, np.uint64(0))
        padded = np.concatenate([np.zeros(REACH - 1, np.uint64), inside, np.zeros(REACH - 1, np.uint64)])
        most = sliding(padded, REACH, np.maximum)
        return np.flatnonzero((most == self.phrase) & (self.phrase != FAR))

    def window_hash(self) -> np.ndarray:
        return self._rolling(WINDOW, WINDOW_MULT, np.uint64(0))

    def candidates(self, located: np.ndarray) -> np.ndarray:
        """Windows whose anchor is among the phrases at the positions ``located``."""
        held = np.full(len(self.phrase), FAR)
        held[located] = self.phrase[located]
        return np.flatnonzero(self.valid & (sliding(held, REACH, np.minimum) == self.least)) if self.windows > 0 else np.zeros(0, np.int64)


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def blobs(keys: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """For each key its rows of the columns as bytes."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(runs_of(keys)), len(keys))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(keys[a]), [c[a:b].tobytes() for c in columns]


# 1. Confirm

PLACES = "bucket int, tag long, phrases binary, hash binary, tags binary, pos binary, many binary"
CONFIRMED = "tag long, phrases binary, pos binary, holders binary"


def record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a schema of ints, longs and binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def in_batches(schema: str, rows: Iterator[tuple], size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield record(schema, held)
            held = []
    if held:
        yield record(schema, held)


def _places(keys: list[int], limit: int = 400_000):
    """Of (text, tag): phrases that recur in this task to their texts, and one place a hash dealt out."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        wholes: list[bytes] = []

        def rows():
            h, t, p, w, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((p, t, h))
            h, t, p, w, a, b = h[order], t[order], p[order], w[order], a[order], b[order]
            lead = np.flatnonzero(runs_of(h))
            size = np.diff(np.append(lead, len(h)))
            many = (size > 1).astype(np.uint8)
            for bucket, x in blobs((h[lead] % np.uint64(len(keys))).astype(np.int64), [h[lead], t[lead], p[lead], many]):
                yield (keys[bucket], None, None, *x)
            words = [b" ".join(wholes[w[i]][a[i] : b[i]].split()) if m else b"" for i, m in zip(lead.tolist(), many.tolist(), strict=True)]
            here = np.repeat(many > 0, size)
            which = np.repeat(np.arange(len(lead)), size)[here]
            for tag, (x,) in blobs(t[here], [which]):
                yield keys[tag % len(keys)], tag, b"\n".join([words[k] for k in np.unique(np.frombuffer(x, np.int64)).tolist()]), None, None, None, None

        size = 0
        for batch in batches:
            words = Words(batch.column(0).to_pylist())
            at = words.anchors()
            if not len(at):
                continue
            doc, last = words.doc[at], at + PHRASE - 1
            held.append((words.phrase[at], batch.column(1).to_numpy()[doc], (at - words.first[doc]).astype(np.int32), np.full(len(at), len(wholes)), words.starts[at], words.starts[last] + words.lengths[last]))
            wholes.append(words.whole)
            size += len(at)
            if size > limit:
                yield from in_batches(PLACES, rows())
                held, wholes, size = [], [], 0
        if held:
            yield from in_batches(PLACES, rows())

    return run


def _confirm(batches):
    """Of the places dealt out by hash, those of hashes that recur: the text that cuts the phrase out, and who gets it."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        passing = []
        for tag, phrases, *x in zip(*[batch.column(k).to_pylist() for k in range(1, 7)], strict=True):
            if phrases is not None:
                passing.append((tag, phrases, None, None))
            else:
                parts.append(tuple(np.frombuffer(b, kind) for b, kind in zip(x, (np.uint64, np.int64, np.int32, np.uint8), strict=True)))
        if passing:
            yield record(CONFIRMED, passing)
    if parts:
        h, t, p, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((p, t, h))
        h, t, p, m = h[order], t[order], p[order], m[order]
        lead = np.flatnonzero(runs_of(h))
        size = np.diff(np.append(lead, len(h)))
        owner = np.repeat(lead, size)
        # A place whose hash recurs within its task has got the phrase there.
        asks = (np.repeat(size, size) > 1) & (m == 0)
        yield from in_batches(CONFIRMED, ((tag, None, *x) for tag, x in blobs(t[owner[asks]], [p[owner[asks]], t[asks]])))


PHRASES = "tag long, phrases binary"


def _cut_out(batches):
    """Phrases of the texts (text, pos, holders) for the texts that hold them."""

    def rows(batch):
        for text, pos, holders in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            words = text.encode("utf-8").split()
            wanted: dict[int, list[bytes]] = {}
            for ps, hs in zip(pos, holders, strict=True):
                for at, holder in zip(np.frombuffer(ps, np.int32).tolist(), np.frombuffer(hs, np.int64).tolist(), strict=True):
                    wanted.setdefault(holder, []).append(b" ".join(words[at : at + PHRASE]))
            for holder, found in wanted.items():
                yield holder, b"\n".join(found)

    for batch in batches:
        yield from in_batches(PHRASES, rows(batch))


# 2. Locate

FIRSTS = "bucket int, doc long, tag long, starts binary, least binary, docs binary, tags binary, first binary, n binary, offset binary, hash binary"
NAMES = [x.split()[0] for x in FIRSTS.split(", ")]


def locate(words: Words, phrases: list[bytes], max_phrases: int) -> np.ndarray:
    """Every position at which one of the phrases occurs, by automata of at most ``max_phrases``."""
    # A text stands as its words between single spaces, so a phrase between spaces matches whole words.
    norms = [b" ".join([b"", *r.split(), b""]).decode("latin-1") for r in words.raws]
    ends = np.cumsum(words.lengths + 1)
    begins = ends - words.lengths - 1
    begins = begins - np.repeat(begins[np.minimum(words.first[:-1], max(0, len(begins) - 1))], np.diff(words.first)) + 1 if len(begins) else begins
    found = []
    for k in range(0, len(phrases), max_phrases):
        automaton = ahocorasick.Automaton()
        for phrase in phrases[k : k + max_phrases]:
            automaton.add_word(f" {phrase.decode('latin-1')} ", len(phrase) + 2)
        automaton.make_automaton()
        for d, norm in enumerate(norms):
            a, b = words.first[d], words.first[d + 1]
            if b - a >= PHRASE:
                at = [end - size + 2 for end, size in automaton.iter(norm)]
                if at:
                    found.append(a + np.searchsorted(begins[a:b], at))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _judge_local(keys: list[int], max_phrases: int, max_bytes: int, limit: int = 1_000_000):
    """Windows of the shards' texts (doc, tag, text, phrases): those to remove, and the first ones dealt out."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        shard: list[tuple[int, int, str]] = []
        phrases: set[bytes] = set()
        size = windows = 0

        def judge_shard():
            words = Words([x[2] for x in shard])
            at = words.candidates(locate(words, sorted(phrases), max_phrases))
            doc = words.doc[at]
            ids, tags = np.array([x[0] for x in shard], np.int64), np.array([x[1] for x in shard], np.int64)
            held.append((words.least[at], words.window_hash()[at] if len(at) else np.zeros(0, np.uint64), ids[doc], tags[doc], (at - words.first[doc]).astype(np.int32)))
            shard.clear()
            phrases.clear()
            return len(at)

        def flush():
            m, h, d, t, s = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((t, s, d, h, m))
            m, h, d, t, s = m[order], h[order], d[order], t[order], s[order]
            first = earliest(m, h, d, s)
            yield from _starts(d[~first], t[~first], s[~first], keys)
            yield from _firsts(m[first], h[first], d[first], t[first], s[first], keys)

        for batch in batches:
            for d, t, text, given in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                shard.append((d, t, text))
                for x in given:
                    phrases.update(x.split(b"\n"))
                size += len(text)
                if size > max_bytes or len(phrases) > max_phrases:
                    windows += judge_shard()
                    size = 0
                    if windows > limit:
                        yield from flush()
                        windows = 0
        if shard:
            judge_shard()
        if held:
            yield from flush()

    return run


def earliest(m, h, d, s) -> np.ndarray:
    """Of rows sorted by window, document and start, those at the place where their window is first."""
    new = runs_of(m, h)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return (d == d[lead]) & (s == s[lead])


def _record(rows: list[dict]) -> pa.RecordBatch:
    return record(FIRSTS, [tuple(r.get(n) for n in NAMES) for r in rows])


def _starts(d, t, s, keys=(0,)):
    """Rows (doc, tag, starts) of windows to remove."""
    order = np.lexsort((s, t, d))
    d, t, s = d[order], t[order], s[order]
    cuts = np.append(np.flatnonzero(runs_of(d, t)), len(d))
    rows = [{"bucket": keys[int(t[a]) % len(keys)], "doc": int(d[a]), "tag": int(t[a]), "starts": s[a:b].tobytes()} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for at in range(0, len(rows), 4096):
        yield _record(rows[at : at + 4096])


def _firsts(m, h, d, t, s, keys: list[int]):
    """Rows of windows for the others to compare: runs of neighbours with one anchor."""
    order = np.lexsort((s, t, d, m))
    m, h, d, t, s = m[order], h[order], d[order], t[order], s[order]
    new = runs_of(m, d, t)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    new |= (s - s[lead]) // 256 != np.concatenate([[0], ((s - s[lead]) // 256)[:-1]]) if len(new) else new
    cuts = np.flatnonzero(new)
    n = np.diff(np.append(cuts, len(m)))
    bucket = (m % np.uint64(len(keys))).astype(np.int64)
    offset = (s - np.repeat(s[cuts], n)).astype(np.uint8)
    rows = []
    heads = dict(blobs(bucket[cuts], [m[cuts], d[cuts], t[cuts], s[cuts], n.astype(np.int32)]))
    bodies = dict(blobs(bucket, [offset, h]))
    for b, x in heads.items():
        rows.append({"bucket": keys[b], "least": x[0], "docs": x[1], "tags": x[2], "first": x[3], "n": x[4], "offset": bodies[b][0], "hash": bodies[b][1]})
    for at in range(0, len(rows), 1024):
        yield _record(rows[at : at + 1024])


# 3. Judge


def _judge(batches):
    """Of the windows dealt out by anchor, those that start earlier elsewhere."""
    parts = []
    for batch in batches:
        passing = []
        for r in batch.to_pylist():
            if r["starts"] is not None:
                passing.append(r)
                continue
            n = np.frombuffer(r["n"], np.int32)
            wide = lambda name, kind: np.repeat(np.frombuffer(r[name], kind), n)  # noqa: B023, E731
            s = wide("first", np.int32) + np.frombuffer(r["offset"], np.uint8)
            parts.append((wide("least", np.uint64), np.frombuffer(r["hash"], np.uint64), wide("docs", np.int64), wide("tags", np.int64), s.astype(np.int32)))
        if passing:
            yield _cut(_record(passing))
    if parts:
        m, h, d, t, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((t, s, d, h, m))
        m, h, d, t, s = m[order], h[order], d[order], t[order], s[order]
        later = ~earliest(m, h, d, s)
        for batch in _starts(d[later], t[later], s[later]):
            yield _cut(batch)


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select(["doc", "tag", "starts"])


def removed_words(n: int, starts: list[bytes] | None) -> np.ndarray:
    """True for the words that a window at one of the starts covers."""
    change = np.zeros(n + 1, np.int64)
    for raw in starts or ():
        at = np.unique(np.frombuffer(raw, np.int32))
        at = at[at + WINDOW <= n]
        change[at] += 1
        change[at + WINDOW] -= 1
    return np.cumsum(change)[:n] > 0


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_phrases: int = 20_000, max_bytes: int = 4_000_000, part_bytes: int = 64 << 20, digest_only: bool = False) -> DataFrame:
    """Each row's identifier with n_words, n_removed and ``kept``: the words left, or their SHA-256.

    There are as many partitions as the session has for shuffles, or more of about ``part_bytes`` of text.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).isNull().alias("no_id"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    total = base.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    keys = partition_keys(spark, parts)

    table = f"passage_texts_{uuid.uuid4().hex}"
    distinct = base.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.first("text").alias("text")).withColumn("tag", F.xxhash64("digest"))
    distinct.repartition(parts, "tag").write.format("parquet").bucketBy(parts, "tag").sortBy("tag").option("compression", "zstd").option("path", shared_dir(spark, "passage-texts")).saveAsTable(table)
    texts = spark.table(table)

    by_tag = lambda df: df.repartition(parts, "tag").groupBy("tag")  # noqa: E731 - the buckets of the texts
    places = texts.select("text", "tag").mapInArrow(_places(keys), PLACES).repartition(parts, "bucket")
    confirmed = materialise(places.mapInArrow(_confirm, CONFIRMED), "confirmed")
    asked = by_tag(confirmed.filter("phrases is null")).agg(F.collect_list("pos").alias("pos"), F.collect_list("holders").alias("holders"))
    cut = texts.select("tag", "text").join(asked, "tag").select("text", "pos", "holders").mapInArrow(_cut_out, PHRASES)
    phrases = by_tag(confirmed.filter("phrases is not null").select("tag", "phrases").unionByName(cut)).agg(F.collect_list("phrases").alias("phrases"))
    shards = texts.join(phrases, "tag").select("first_doc", "tag", "text", "phrases")
    judged = shards.mapInArrow(_judge_local(keys, max_phrases, max_bytes), FIRSTS).repartition(parts, "bucket").mapInArrow(_judge, "doc long, tag long, starts binary")
    gone = by_tag(judged).agg(F.collect_list(F.struct("doc", "starts")).alias("gone"))

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def rewrite(text: pa.Array, starts: pa.Array) -> pa.Array:
        counts, removed, kept = [], [], []
        for t, at in zip(text.to_pylist(), starts.to_pylist(), strict=True):
            left = words = t.encode("utf-8").split()
            if at:
                off = removed_words(len(words), at)
                left = [w for w, o in zip(words, off.tolist(), strict=True) if not o]
            out = b" ".join(left)
            counts.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(hashlib.sha256(out).hexdigest() if digest_only else out.decode("utf-8"))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])

    own = F.transform(F.filter("gone", lambda x: x["doc"] == F.col("first_doc")), lambda x: x["starts"])
    results = texts.join(gone, "tag", "left").select("digest", "first_doc", rewrite("text", own).alias("r"))
    results = materialise(results.select("digest", "first_doc", "r.*"), "passages")  # so that the join can split a text with many copies
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # its files go with the session
    copy = (F.col("doc") > F.col("first_doc")) & (F.col("n_words") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest() if digest_only else ""
    rows = base.select("doc", "no_id", "digest").join(results, "digest")
    return rows.select(
        F.when(~F.col("no_id"), F.col("doc")).alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.col("kept")).alias("kept"),
    )


def op8_substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return dedup_passages(docs, digest_only=True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS turn FROM g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE turn > 1
), words AS (
  SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
