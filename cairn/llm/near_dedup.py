"""Near-duplicate classes by Order MinHash.

Words are lower-cased runs of letters, digits and non-ASCII; a k-mer is some words in a row and
carries the number of its earlier occurrences in the document. For each of many permutations a
few least labelled k-mers are kept in text order and hashed to a key, so the chance that two
documents share a key follows their edit similarity. The number of words of a k-mer, of k-mers
of a key and of keys depends on the length of the text (``TIERS``), so that texts of similarity
0.8 and of any length share a key with a chance above 0.99 wherever their words are changed.

Documents with equal words are one text, named by a 64-bit digest of its words and not by an
identifier, which rows can lack or share. Rows of a
key are joined within a task first and go on only if several texts share the key. Candidates are
verified by a banded alignment of whole texts: linked if the edit distance in words is at most
``1 - similarity`` of the longer text. Classes are the connected components of the verified
links, found by alternating stars on tables.

There are two rounds. The first tests each text with the least one of each of its keys, which
makes most near copies one class. The second tests all other pairs that share a key and lie in
different classes, whatever their number: a key's texts are dealt to cells of bounded size, and
those outside its largest class visit all of them. Only pairs whose lengths or counts of words
show that they cannot be similar are left out.

Cases: null and wordless texts are classes of their own; a null identifier is smaller than every other; rows that repeat a text
share its class, different texts under one identifier or none are classed each for itself; an
empty table gives an empty result; further columns are not needed.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.words import MULT, hashes, mix
from cairn.operators.graphs import components
from cairn.session import arrow_batches, materialise, partition_keys

SIMILARITY = 0.8


class Tier(NamedTuple):
    """Sketches of texts of ``least`` to ``most`` words: least k-mers of ``k`` words, ``sampled`` a sketch."""

    least: int
    most: int
    k: int
    sampled: int
    sketches: int
    in_text_order: bool


#: Texts whose lengths differ by a quarter at most have a tier in common, so tiers overlap by that.
TIERS = [Tier(1, 18, 1, 3, 32, False), Tier(16, 80, 2, 3, 88, True), Tier(65, 1 << 40, 3, 2, 88, True)]
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
FAR = np.uint64((1 << 64) - 1)
LOW = np.uint64((1 << 32) - 1)


SEEDS = [mix(np.arange(1 + t * 2000, 1 + t * 2000 + 2 * tier.sketches, dtype=np.uint64) * np.uint64(MULT)).reshape(2, -1) | np.uint64(1) for t, tier in enumerate(TIERS)]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and where each text's words begin (and one more)."""
    whole = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    mask = np.concatenate([[False], IS_WORD[whole], [False]])
    change = np.flatnonzero(mask[1:] != mask[:-1])
    starts, lengths = change[::2], change[1::2] - change[::2]
    first = np.searchsorted(starts, np.cumsum([0, *[len(r) + 1 for r in raws]]))
    return hashes(whole, starts, lengths), first


def sketch(raws: list[bytes]) -> tuple[list[bytes | None], np.ndarray]:
    """The keys of each text of its tiers, None without words, and the texts' numbers of words."""
    words, first = word_hashes(raws)
    n = np.diff(first)
    found: list[bytes | None] = [b"" if c else None for c in n.tolist()]
    for t, tier in enumerate(TIERS):
        has = np.flatnonzero((n >= tier.least) & (n <= tier.most))
        if len(has):
            for i, keys in zip(has.tolist(), _tier_keys(words, first[has], n[has], t), strict=True):
                found[i] += keys.tobytes()
    return found, n


def _tier_keys(words: np.ndarray, first: np.ndarray, n: np.ndarray, t: int) -> np.ndarray:
    """A row of keys for each text, whose ``n`` words begin at ``first``."""
    tier = TIERS[t]
    count = n - tier.k + 1
    starts = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    place = np.arange(starts[-1]) - starts[doc]
    at = first[doc] + place
    kmer = np.zeros(len(at), np.uint64)
    for j in range(tier.k):
        kmer = kmer * np.uint64(MULT) + words[at + j]
    kmer = mix(kmer)
    order = np.lexsort((place, kmer, doc))
    new = np.ones(len(order), bool)
    new[1:] = (kmer[order][1:] != kmer[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    seen = np.empty(len(order), np.uint64)
    seen[order] = (np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]).astype(np.uint64)
    label = mix(kmer + seen * np.uint64(0xC2B2AE3D27D4EB4F))
    low = place.astype(np.uint64)
    keys = np.empty((len(n), tier.sketches), np.uint64)
    base = starts[:-1]
    for i in range(tier.sketches):
        value = ((label ^ SEEDS[t][0, i]) * SEEDS[t][1, i] & ~LOW) | low
        sampled = []
        for _ in range(tier.sampled):
            least = np.minimum.reduceat(value, base)
            ok = least != FAR
            where = base + np.where(ok, least & LOW, 0).astype(np.int64)
            sampled.append(np.where(ok, where, -1))
            value[where[ok]] = FAR
        places = np.stack(sampled)
        labels = np.where(places >= 0, label[np.maximum(places, 0)], np.uint64(7))
        labels = np.take_along_axis(labels, np.argsort(places, axis=0), axis=0) if tier.in_text_order else np.sort(labels, axis=0)
        key = np.full(len(n), np.uint64(i + 1 + t * 1000))
        for x in labels:
            key = mix(key * np.uint64(MULT) + x)
        keys[:, i] = key
    return keys


def distance_within(a: list, b: list, limit: int) -> int:
    """The edit distance of two sequences, or ``limit`` + 1 if it is larger.

    Cells more than ``limit`` off the diagonal cannot matter; the others of a column stand in the
    bits of two integers as differences (+1 or -1) down the column.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > limit:
        return limit + 1
    head = 0
    while head < m and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : m - tail]
    n, m = len(a), len(b)
    if not m:
        return n if n <= limit else limit + 1
    rows: dict = {}
    for i, w in enumerate(a):
        rows[w] = rows.get(w, 0) | 1 << (i + limit)
    # Bit r of column j is row j - limit + r; the band has 2 * limit + 1 rows.
    full = (1 << 2 * limit + 1) - 1
    up, down = full >> limit << limit, 0
    # The distance is followed down the diagonal that ends in the last cell.
    score, diagonal = n - m, 1 << limit + n - m
    for j, w in enumerate(b):
        match = rows.get(w, 0) >> j & full
        level = (((match & up) + up) ^ up | match | down) & full
        if not level & diagonal:
            score += 1
            if score > limit:
                return score
        rises, falls = (down | ~(level | up)) & full, level & up
        up, down = (falls | ~(level >> 1 | rises)) & full, level >> 1 & rises
    return score


def similar(a: list, b: list, similarity: float) -> bool:
    """Whether at most ``1 - similarity`` of the longer one's words are edited."""
    limit = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    return distance_within(a, b, limit) <= limit


# Candidates

DEALT = "bucket int, a binary, b binary"
DEALT_NAMES = ["bucket", "a", "b"]
#: Texts of a key that a cell holds; beyond, a key has several cells.
CELL = 2048
#: Pairs that are compared at once.
CHUNK = 50_000
#: Words are counted in so many places, least and most, up to MOST, to tell that two texts cannot be similar.
BAGS, MOST = (64, 4096), 15


def _split(at: np.ndarray, columns: list[np.ndarray], buckets: list[int]) -> Iterator[pa.RecordBatch]:
    """A blob for each bucket."""
    order = np.argsort(at, kind="stable")
    at, columns = at[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.append([True], at[1:] != at[:-1])), len(at))
    rows = [[buckets[int(at[a])] for a in cuts[:-1]], *[[c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for c in columns]]
    yield pa.record_batch([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=DEALT_NAMES)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the length of the run that each row is in."""
    starts = np.flatnonzero(np.append([True], key[1:] != key[:-1]))
    lengths = np.diff(np.append(starts, len(key)))
    return starts, np.repeat(lengths, lengths)


def _rows(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (key, doc) in order."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], docs[new]


def _local_keys(buckets: list[int], limit: int = 16_000, many: int = 16):
    """Rows (key, doc) dealt out by key; of a key with more than ``many`` texts here only two.

    The others of such a key are known to share it, so they go anywhere (column a is empty then
    and b has keys and docs), and no key gathers its texts in one task.
    """

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            keys, docs = _rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            starts, length = _runs(keys)
            place = np.arange(len(keys)) - np.repeat(starts, length[starts])
            known = (length > many) & (place > 1)
            k, d = keys[~known], docs[~known]
            yield from _split((k % np.uint64(len(buckets))).astype(np.int64), [k, d], buckets)
            k, d = keys[known], docs[known]
            for at in range(0, len(k), 4096):
                blob = k[at : at + 4096].tobytes() + d[at : at + 4096].tobytes()
                yield pa.record_batch([pa.array([buckets[int(d[at]) % len(buckets)]], pa.int32()), pa.array([b""], pa.binary()), pa.array([blob], pa.binary())], names=DEALT_NAMES)

        n = 0
        for batch in batches:
            docs = batch.column(0).to_numpy()
            packed = batch.column(1).to_pylist()
            keys = np.frombuffer(b"".join(packed), np.uint64)
            held.append((keys, np.repeat(docs, [len(p) // 8 for p in packed])))
            n += len(docs)
            if n >= limit:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    return run


def _key_rows(keys: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 65_536):
        yield pa.record_batch([pa.array(keys[at : at + 65_536].view(np.int64)), pa.array(docs[at : at + 65_536])], names=["key", "doc"])


def _global_keys(batches):
    parts = []
    for batch in batches:
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if a:
                parts.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)))
            else:
                yield from _key_rows(np.frombuffer(b[: len(b) // 2], np.uint64), np.frombuffer(b[len(b) // 2 :], np.int64))
    if parts:
        keys, docs = _rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        shared = _runs(keys)[1] > 1
        yield from _key_rows(keys[shared], docs[shared])


def shared_keys(texts: DataFrame, parts: int) -> DataFrame:
    """Rows (key, doc) of the keys that several of the texts (doc, keys) have."""
    buckets = partition_keys(texts.sparkSession, parts)  # a blob a task and partition
    dealt = texts.select("doc", "keys").mapInArrow(_local_keys(buckets), DEALT).repartition(parts, "bucket")
    return dealt.mapInArrow(_global_keys, "key long, doc long").distinct()


def star_edges(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct edges (a, b), a < b, of rows (key, doc, size): each text with its key's least one."""
    least = rows.groupBy("key").agg(F.min(F.struct("doc", "size")).alias("m"))
    met = rows.join(least, "key").filter("doc <> m.doc").filter(F.least("size", "m.size") >= similarity * F.greatest("size", "m.size"))
    return met.select(F.col("m.doc").alias("a"), F.col("doc").alias("b")).distinct()


def places(words: np.ndarray) -> np.ndarray:
    """Places of the signatures of texts of so many words: about one a word, powers of two."""
    size = np.maximum(BAGS[0], np.minimum(BAGS[1], words)).astype(np.float64)
    return 1 << np.ceil(np.log2(size)).astype(np.int64)


def bag(raws: list[bytes]) -> list[bytes]:
    """The words of each text counted in :func:`places`, MOST at most, two places a byte."""
    words, first = word_hashes(raws)
    size = places(np.diff(first))
    starts = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(raws)), np.diff(first))
    at = starts[doc] + (words & (size[doc] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=starts[-1]), MOST).astype(np.uint8)
    packed = counts[::2] << 4 | counts[1::2]
    return [packed[a // 2 : b // 2].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def counts_in(bags: list[bytes], size: int) -> np.ndarray:
    """A row of ``size`` places for each signature of that many places or more."""
    out = np.empty((len(bags), size), np.uint8)
    lengths = np.fromiter(map(len, bags), np.int64, len(bags))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        packed = np.frombuffer(b"".join([bags[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), n)
        wide = np.stack([packed >> 4, packed & MOST], axis=2).reshape(len(rows), 2 * n)
        while wide.shape[1] > size:
            half = wide.shape[1] // 2
            wide = np.minimum(wide[:, :half] + wide[:, half:], MOST)
        out[rows] = wide
    return out


def differ_too_much(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether counts show that more than ``limit`` words differ.

    An edit lowers a place's surplus of either side by one at most, so no similar pair is lost.
    """
    more = np.maximum(a, b) - np.minimum(a, b)
    up = np.where(a > b, more, 0).sum(axis=1, dtype=np.int64)
    return np.maximum(up, more.sum(axis=1, dtype=np.int64) - up) > limit


def can_be_similar(x: np.ndarray, y: np.ndarray, bags: list[bytes], longer: np.ndarray, similarity: float) -> np.ndarray:
    """False for the pairs (x, y) of rows of ``bags`` whose words cannot be similar, on few places, then on all."""
    ok = np.ones(len(x), bool)
    limit = (longer * (1 - similarity) + 1e-9).astype(np.int64)
    length = np.fromiter(map(len, bags), np.int64, len(bags))
    size = 2 * np.minimum(length[x], length[y])
    for few in (True, False):
        here = np.minimum(size, 128) if few else size
        for n in np.unique(here[ok]).tolist():
            rows = np.flatnonzero(ok & (here == n))
            if not few and n <= 128:
                continue
            used, at = np.unique(np.concatenate([x[rows], y[rows]]), return_inverse=True)
            wide = counts_in([bags[i] for i in used.tolist()], n)
            step = max(1, CHUNK * 128 // n)
            for k in range(0, len(rows), step):
                r = rows[k : k + step]
                ok[r] = ~differ_too_much(wide[at[k : k + len(r)]], wide[at[len(rows) + k : len(rows) + k + len(r)]], limit[r])
    return ok


SLOTS = np.cumsum([0, *[t.sketches for t in TIERS]])
SLOTS_OF = {has: np.concatenate([np.arange(a, b) for a, b, h in zip(SLOTS[:-1], SLOTS[1:], has, strict=True) if h] or [np.zeros(0, np.int64)]) for has in itertools.product((False, True), repeat=len(TIERS))}


def marks_in(marks: list[bytes], sizes: np.ndarray, missing: int) -> np.ndarray:
    """A row of keys for each text, by tier and sketch; ``missing`` where it has no such tier."""
    out = np.full((len(marks), SLOTS[-1]), missing, np.uint64)
    for i, (raw, n) in enumerate(zip(marks, sizes.tolist(), strict=True)):
        out[i, SLOTS_OF[tuple(t.least <= n <= t.most for t in TIERS)]] = np.frombuffer(raw, np.uint64)
    return out


def first_meeting(x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first that two rows of keys share, so that each pair comes up once."""
    same = x == y
    return x[np.arange(len(x)), same.argmax(axis=1)] == key


def _cells(similarity: float):
    """Pairs (a, b) of each cell: every visitor with every text that lives there, in other groups.

    Rows (key, cell, visits, doc, group, size, lives, bag, marks) stand in order of key, cell and
    visits. A pair comes out under the first key that the two texts share.
    """

    def once(live, visit, h, v, live_marks, visit_marks):
        ok = np.ones(len(h), bool)
        a, at = np.unique(h, return_inverse=True)
        b, to = np.unique(v, return_inverse=True)
        x = marks_in([live_marks[i] for i in a.tolist()], live[3][a], 0)
        y = marks_in([visit_marks[i] for i in b.tolist()], visit[3][b], 1)
        for k in range(0, len(h), 8192):
            r = slice(k, k + 8192)
            ok[r] = first_meeting(x[at[r]], y[to[r]], visit[5][v[r]].view(np.uint64))
        return ok

    def pairs(live, visit, live_bags, visit_bags, live_marks, visit_marks):
        # live and visit: cell number, doc, group, size, major, key
        first, end = np.searchsorted(live[0], visit[0], "left"), np.searchsorted(live[0], visit[0], "right")
        count = end - first
        total = np.cumsum(count)
        bags = [*live_bags, *visit_bags]
        begin = 0
        while begin < len(total):
            done = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, done + CHUNK, "right")))
            c = count[begin:stop]
            v = np.repeat(np.arange(begin, stop), c)
            h = np.arange(len(v)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[begin:stop], c)
            begin = stop
            x, y = live[1][h], visit[1][v]
            longer = np.maximum(live[3][h], visit[3][v])
            # Two texts outside the key's major group visit each other; one of the two meetings counts.
            ok = (live[2][h] != visit[2][v]) & (live[4][h] | (y < x)) & (np.minimum(live[3][h], visit[3][v]) >= similarity * longer)
            h, v, x, y, longer = h[ok], v[ok], x[ok], y[ok], longer[ok]
            ok = np.flatnonzero(can_be_similar(h, v + len(live_bags), bags, longer, similarity))
            ok = ok[once(live, visit, h[ok], v[ok], live_marks, visit_marks)]
            if len(ok):
                x, y = x[ok], y[ok]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        home: list[np.ndarray] | None = None
        home_bags: list[bytes] = []
        home_marks: list[bytes] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cell, doc, group, size = (batch.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
            visits, major = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 6))
            bags, marks = batch.column(7).to_pylist(), batch.column(8).to_pylist()
            new = np.append([last != (key[0], cell[0])], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
            number = np.cumsum(new)  # 0 is the cell that the last batch ended with
            columns = (number, doc, group, size, major, key)
            pick = lambda values, where: [values[i] for i in np.flatnonzero(where).tolist()]
            live, live_bags, live_marks = [c[~visits] for c in columns], pick(bags, ~visits), pick(marks, ~visits)
            if home is not None and not new[0]:
                live, live_bags, live_marks = [np.concatenate(x) for x in zip(home, live, strict=True)], home_bags + live_bags, home_marks + live_marks
            yield from pairs(live, [c[visits] for c in columns], live_bags, pick(bags, visits), live_marks, pick(marks, visits))
            stays = live[0] == number[-1]
            home, home_bags, home_marks = [c[stays] for c in live], pick(live_bags, stays), pick(live_marks, stays)
            home[0] = np.zeros_like(home[0])
            last = (key[-1], cell[-1])

    return run


def all_edges(rows: DataFrame, bags: DataFrame, cell: int = CELL, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct edges (a, b), a < b, of all texts in different groups that share a key and can be similar.

    ``rows`` has (key, doc, group, size), ``bags`` has (doc, bag, keys). A text lives in one of its key's
    cells, which hold about ``cell`` texts each; texts outside the key's largest group visit all of
    its cells. Only rows of keys that several groups share get their signatures.
    """
    counts = materialise(rows.groupBy("key", "group").count(), "counts")
    keys = counts.groupBy("key").agg(F.sum("count").alias("n"), F.max_by("group", F.struct("count", "group")).alias("major"), F.count("*").alias("groups"))
    keys = materialise(keys.filter("groups > 1").select("key", "major", F.ceil(F.col("n") / cell).cast("int").alias("cells")), "contested")
    met = materialise(rows.join(keys, "key").withColumn("lives", F.col("group") == F.col("major")), "contested-rows")
    met = met.join(bags.select("doc", "bag", F.col("keys").alias("marks")), "doc")
    columns = ["doc", "group", "size", "lives", "bag", "marks"]
    live = met.select("key", F.pmod(F.xxhash64("doc"), F.col("cells")).cast("int").alias("cell"), F.lit(False).alias("visits"), *columns)
    visit = met.filter("not lives").select("key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(True).alias("visits"), *columns)
    dealt = live.unionByName(visit).repartition("key", "cell").sortWithinPartitions("key", "cell", "visits")
    return dealt.mapInArrow(_cells(similarity), "a long, b long").distinct()


# Verification


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            a, b, good = [], [], []
            held: dict[bytes, list] = {}
            for x, y, p, q in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                words = []
                for raw in (p, q):
                    if raw not in held:
                        if len(held) > 16:
                            held.clear()
                        held[raw] = WORD.findall(zstandard.ZstdDecompressor().decompress(raw))
                    words.append(held[raw])
                if similar(words[0], words[1], similarity):
                    a.append(x)
                    b.append(y)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verified(edges: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The edges whose texts are similar; ``words`` has (doc, packed)."""
    left = words.select(F.col("doc").alias("a"), F.col("packed").alias("p"))
    right = words.select(F.col("doc").alias("b"), F.col("packed").alias("q"))
    return edges.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(_verify(similarity), "a long, b long")


# Classes


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The identifier of each row, and a hash of identifier and text."""
    doc = F.col(id_col).cast("long")
    return [doc.alias("doc"), F.xxhash64(doc, F.col(text_col)).alias("row")]


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, max_broadcast_ids: int = 200_000) -> DataFrame:
    """(doc, row, class_id, stays) of every row: its keys, the least identifier of its class, and whether it stands for it.

    Of the rows with the least identifier, a null one being the least, that with the least hash
    stands for the class; rows that repeat both identifier and text are one document.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def lower(text: str | None) -> bytes:
        return b"" if text is None else text.encode("utf-8").lower()

    def node(words: list[bytes]) -> int:
        return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)

    def describe(batches):
        for batch in batches:
            raws = [lower(t) for t in batch.column(1).to_pylist()]
            packed, n = sketch(raws)
            nodes = [node(WORD.findall(r)) for r in raws]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(nodes, pa.int64()), pa.array(n.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(bag(raws), pa.binary())], names=["doc", "no_id", "row", "node", "size", "keys", "bag"])

    @F.arrow_udf("struct<doc: long, packed: binary>")
    def pack(text: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=1)
        raws = [lower(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([node(WORD.findall(r)) for r in raws], pa.int64()), pa.array([squeeze.compress(r) for r in raws], pa.binary())], names=["doc", "packed"])

    base = docs.select(*_row_keys(docs, id_col, text_col), F.col(text_col).alias("text"), F.col(id_col).isNull().alias("no_id"))
    described = materialise(base.select("doc", "text", "no_id", "row").mapInArrow(describe, "doc long, no_id boolean, row long, node long, size int, keys binary, bag binary"), "sketches")
    worded = described.filter("size > 0")
    # From here to the classes, ``doc`` is the node: texts, not identifiers, are compared and linked.
    least = F.min(F.struct((~F.col("no_id")).alias("some"), "doc", "row")).alias("least")
    texts = materialise(
        worded.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("bag").alias("bag"), least).withColumnRenamed("node", "doc"), "texts"
    )
    shared = materialise(shared_keys(texts, parts), "shared")
    sizes = texts.select("doc", "size")
    tested = links = None
    labels = texts.select("doc", F.col("doc").alias("root"))
    # First stars, which make one class of most near copies; then all that is left between classes.
    for step in ("stars", "all"):
        if step == "stars":
            edges = star_edges(shared.join(sizes, "doc"), similarity)
        else:
            edges = all_edges(shared.join(sides, "doc"), texts.select("doc", "bag", "keys"), similarity=similarity)
        if tested is not None:
            edges = edges.join(tested, ["a", "b"], "left_anti")
        edges = materialise(edges, "candidates")
        # Texts of the candidates, found by the hash of one of their rows.
        ends = edges.select(F.col("a").alias("doc")).unionByName(edges.select(F.col("b").alias("doc"))).distinct()
        # Up to ``max_broadcast_ids`` identifiers are sent to the texts; beyond, both are shuffled.
        few = materialise(texts.join(ends, "doc").select("row"), "ends")
        few = F.broadcast(few) if few.count() <= max_broadcast_ids else few.hint("merge")
        words = materialise(base.join(few, "row", "left_semi").select(pack("text").alias("p")).select("p.*").dropDuplicates(["doc"]), "packed")
        found = materialise(verified(edges, words, similarity), "verified")
        links = found if links is None else links.unionByName(found)
        labels = materialise(texts.select("doc").join(components(links).withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("root", "doc").alias("root")), "labels")
        tested = edges
        sides = texts.select("doc", "size").join(labels.withColumnRenamed("root", "group"), "doc")
    roots = materialise(texts.select("doc", "least").join(labels, "doc"), "roots")
    found = roots.groupBy("root").agg(F.min("least").alias("least"))
    classes = materialise(roots.select(F.col("doc").alias("node"), "root").join(found, "root").select("node", "least"), "classes")
    joined = described.select("doc", "row", "node", "size").join(classes, "node", "left")
    stays = (F.col("size") == 0) | (F.col("doc").eqNullSafe(F.col("least.doc")) & (F.col("row") == F.col("least.row")))
    return joined.select("doc", "row", F.when(F.col("size") > 0, F.col("least.doc")).otherwise(F.col("doc")).alias("class_id"), stays.alias("stays"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least identifier of the class."""
    return classify(docs, id_col, text_col, **options).select(F.col("doc").alias(id_col), "class_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their classes."""
    keys = [F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "row"]
    gone = classify(docs, id_col, text_col, **options).filter("not stays").select(*keys).distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole"), *_row_keys(docs, id_col, text_col)).select("whole", *keys)
    return rows.join(gone, ["doc", "row"], "left_anti").select("whole.*")


def op10_near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and whether the row stays."""
    return near_classes(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
