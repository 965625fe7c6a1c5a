"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``n``
consecutive words of one test item; a shorter item (but not an empty one) is one window. Tasks
scan the windows of their documents: a window made of test words only is hashed, looked up in
the set, and each hit is verified word for word.

The set is broadcast while the memory that it takes, worked out from the test table's words
(:func:`set_bytes`), stays within ``max_broadcast_bytes``; beyond that hashes of the windows of
both sides meet in a shuffle join instead, and hits are verified word for word, with the same result.

Cases: null or wordless texts have no words and no hits; null and wordless items have no
windows; repeated items count once per item_id; repeated documents each get their row; an empty
test table leaves every document clean; texts of any length are scanned whole; further columns,
whatever their names, travel in a struct.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import arrow_batches, materialise

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = "struct<n_words: long, hits: array<int>, items: array<string>>"


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else WORD.findall(text.encode("utf-8").lower())


class GramSet:
    """The test windows by length: sorted hashes, where their words stand in the items, and the items.

    Everything but the vocabulary is arrays: about 25 bytes a test word. :func:`set_bytes` bounds it all.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        ids, self.lengths = [], np.zeros(len(items), np.int64)
        for k, (_, text) in enumerate(items):
            own = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            ids.append(np.array(own, np.int32))
            self.lengths[k] = len(own)
        #: The items' words in one array.
        self.words = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        begins = np.cumsum(self.lengths) - self.lengths
        self.by_length = {}
        for size in np.unique(np.minimum(self.lengths[self.lengths > 0], n)).tolist():
            mine = np.flatnonzero(self.lengths >= n if size == n else self.lengths == size)
            count = self.lengths[mine] - size + 1
            owner = np.repeat(mine, count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[mine], count)
            seed = 1
            while True:  # another multiplier if two different windows share a hash
                powers = self.powers(size, seed)
                hashes = np.zeros(len(at), np.uint64)
                for k in range(size):
                    hashes += self.words[at + k].astype(np.uint64) * powers[k]
                order = np.lexsort((owner, hashes))
                hashes, places, owners = hashes[order], at[order], owner[order]
                lead = np.flatnonzero(np.append([True], hashes[1:] != hashes[:-1]))
                first = np.repeat(places[lead], np.diff(np.append(lead, len(places))))
                if all((self.words[places + k] == self.words[first + k]).all() for k in range(size)):
                    break
                seed += 2
            #: Distinct hashes, the place of each window's words, and where its items begin and end in ``owners``.
            self.by_length[size] = (powers, hashes[lead], places[lead], np.append(lead, len(places)), owners.astype(np.int32))

    @staticmethod
    def powers(size: int, seed: int) -> np.ndarray:
        out, mult = np.empty(size, np.uint64), 0x9E3779B97F4A7C15 + 2 * seed
        x = 1
        for i in range(size):
            x = x * mult % (1 << 64)
            out[i] = x
        return out

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[int], list[str]]]:
        """For each text its number of words, the positions hit and the items found."""
        split = [words_of(t) for t in texts]
        # The texts stand in one array, each followed by 0, which no window contains.
        starts = np.cumsum([0, *[len(w) + 1 for w in split]])
        ids = np.zeros(starts[-1], np.int64)
        for at, words in zip(starts, split, strict=False):
            ids[at : at + len(words)] = list(map(self.vocab.get, words, repeat(0)))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        cover = np.zeros(len(ids) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for size, (powers, hashes, places, cuts, owners) in self.by_length.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            keys = np.zeros(len(at), np.uint64)
            for k in range(size):
                keys += ids[at + k].astype(np.uint64) * powers[k]
            place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            same = hashes[place] == keys
            at, place = at[same], place[same]
            same = np.ones(len(at), bool)
            for k in range(size):
                same &= ids[at + k] == self.words[places[place] + k]
            at, place = at[same], place[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            docs = np.searchsorted(starts, at, side="right") - 1
            for doc, gram in set(zip(docs.tolist(), place.tolist(), strict=True)):
                items[doc].update(self.items[k] for k in owners[cuts[gram] : cuts[gram + 1]].tolist())
        covered = np.cumsum(cover)[:-1] > 0
        return [
            (len(words), np.flatnonzero(covered[at : at + len(words)]).tolist(), sorted(found))
            for at, words, found in zip(starts, split, items, strict=False)
        ]


def set_bytes(tests: DataFrame) -> int:
    """A bound on the memory that the set takes while it is built, from counts made by Spark.

    A word takes 4 bytes, its window at most 96 while windows are sorted, and at most one entry of
    the vocabulary, 180 bytes and the word; an item takes 150 bytes and its identifier.
    """
    words = _words_column(F.col("text"))
    rows = tests.select(F.size(words).alias("n"), F.octet_length("text").alias("b"), F.octet_length("item_id").alias("i"))
    found = rows.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("i").alias("i"), F.count("*").alias("items")).first()
    distinct = tests.select(F.explode(words).alias("w")).agg(F.approx_count_distinct("w").alias("d")).first()["d"]
    return (found["n"] or 0) * 100 + int(1.2 * distinct) * 180 + 2 * (found["b"] or 0) + found["items"] * 150 + (found["i"] or 0)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_broadcast_bytes: int = 128 << 20) -> DataFrame:
    """Each row of ``docs`` as struct ``row`` with ``hits``: n_words, word positions hit, items."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    if set_bytes(tests) > max_broadcast_bytes:
        return _find_by_join(rows, tests, n)
    grams = spark.sparkContext.broadcast(GramSet([("null" if r.item_id is None else r.item_id, r.text) for r in tests.collect()], n))

    @F.arrow_udf(HITS)
    def scan(text: pa.Array) -> pa.Array:
        found = grams.value.scan(text.to_pylist())
        return pa.array(
            [{"n_words": c, "hits": h, "items": i} for c, h, i in found],
            pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]),
        )

    return rows.withColumn("hits", scan(F.col("row.text")))


def _words_column(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD_SQL), F.lit(0))


def _windows(words, size, gram):
    """Structs (start, size, hash) of the windows of ``size`` words, with their words if ``gram``; none if there are fewer."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    text = lambda i: F.array_join(F.slice(words, i + 1, size), " ")
    return F.transform(starts, lambda i: F.struct(i.alias("start"), size.alias("size"), F.xxhash64(text(i)).alias("hash"), *([text(i).alias("gram")] if gram else [])))


def _find_by_join(rows: DataFrame, tests: DataFrame, n: int) -> DataFrame:
    """The same result by a shuffle join of window hashes, for test tables too large to broadcast."""
    tests = tests.select(F.coalesce("item_id", F.lit("null")).alias("item"), _words_column(F.col("text")).alias("w")).filter(F.size("w") > 0)
    grams = tests.select("item", F.explode(_windows(F.col("w"), F.least(F.size("w"), F.lit(n)), True)).alias("g")).select("item", "g.size", "g.hash", "g.gram").distinct()
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # n numbers at most
    keyed = rows.withColumn("w", _words_column(F.col("row.text"))).withColumn("key", F.sha2(F.coalesce("row.text", F.lit("")), 256))
    every = F.concat(*[_windows(F.col("w"), F.lit(s), False) for s in sizes]) if sizes else F.array().cast("array<struct<start:int,size:int,hash:bigint>>")
    # Hits of equal texts are found once; the windows travel as a hash each, and only hits meet the items' words.
    met = keyed.select("key", F.explode(every).alias("g")).select("key", "g.*").distinct().join(grams, ["size", "hash"])
    found = materialise(met.groupBy("key").agg(F.collect_set(F.struct("start", "size", "gram", "item")).alias("met")), "hits")
    joined = keyed.join(found, "key", "left")
    same = lambda x: F.array_join(F.slice(F.col("w"), x["start"] + 1, x["size"]), " ") == x["gram"]
    joined = joined.withColumn("met", F.coalesce(F.filter("met", same), F.array().cast("array<struct<start:int,size:int,gram:string,item:string>>")))
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("met", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))))
    items = F.array_sort(F.array_distinct(F.transform("met", lambda x: x["item"])))
    return joined.select("row", F.struct(F.size("w").cast("long").alias("n_words"), hits.alias("hits"), items.alias("items")).alias("hits"))


def contaminated(hits: str = "hits", one_in: int = 20):
    """True where at least one word in ``one_in`` is hit."""
    n = F.size(f"{hits}.hits").cast("long")
    return (n > 0) & (one_in * n >= F.col(f"{hits}.n_words"))


@F.arrow_udf(T.StringType())
def cut_spans(text: pa.Array, hits: pa.Array) -> pa.Array:
    """The texts without the words at the given positions."""
    out = []
    for t, at in zip(text.to_pylist(), hits.to_pylist(), strict=True):
        if t is None or not at:
            out.append(t)
            continue
        raw, gone, keep, last = t.encode("utf-8"), set(at), [], 0
        for i, m in enumerate(WORD.finditer(raw.lower())):
            if i in gone:
                keep.append(raw[last : m.start()])
                last = m.end()
        out.append(b"".join([*keep, raw[last:]]).decode("utf-8"))
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``."""
    found = find_hits(docs, benchmark, n)
    return found.select(*[(cut_spans(F.col("row.text"), F.col("hits.hits")).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)) for c in docs.columns])


def op7_decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    found = find_hits(docs, benchmark)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("hits.n_words").alias("n_words"),
        F.size("hits.hits").cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bg AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM bg
), dg AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, i, size, item_id FROM dg JOIN bg USING (size, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
