"""Spelling variants: words one edit apart, the form that each is a variant of, and the root of its chain.

The vocabulary is scanned in sorted order. The edit matrix of a word against the list is kept as rows of
a band of three cells, one row a letter of the listed word; a word that begins like the one before takes over
the rows of their common prefix, and where no cell of a row is at most one, all words that go on with that
prefix are skipped, with those after it up to the next letter that could follow.

So that no task scans the whole vocabulary, words meet in zones. Of two words one edit apart, either the first
half of the shorter one begins both or its second half ends both, so each word goes to the lists of its
beginnings and of its endings, where only what lies between is compared. A list of more than ``limit`` words is
split in the same manner, by halves of what lies between, until that is a single letter: such lists are bounded
by the alphabet. So no pair is lost however many words begin or end alike.

Cases: a null text has no words; a null identifier counts as the empty text where it enters a checksum; empty
texts and tables give nothing; repeated rows count again; of near words with the same number the first in
code-point order is the form; words may be of any length; further columns are not needed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import arrow_batches, materialise

LETTER = "[a-zÀ-ÿ]"
#: One in so many runs of a document loses a letter.
MODULUS = 97
#: Letters and occurrences that a word has at least.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Words of a list beyond which it is split. Lists that leave one letter of the shorter word open are not: the alphabet
#: of 26 + 64 letters bounds them.
LIMIT = 300
LAST = chr(0x10FFFF)


def runs_of(doc_id: int | None, text: str | None, run: re.Pattern) -> Counter:
    """The lower-cased runs of a text that ``run`` finds, after deletions, with their numbers."""
    found = Counter(run.findall((text or "").encode("utf-8").lower().decode("utf-8")))  # bytes: A-Z only
    start, crc32, changed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), zlib.crc32, []
    for word in found:
        h = crc32(word.encode("utf-8"), start)
        if not h % MODULUS:
            changed.append((word, h))
    for word, n, h in [(word, found.pop(word), h) for word, h in changed]:
        at = h % len(word)
        found[word[:at] + word[at + 1 :]] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, held_words: int = 400_000) -> DataFrame:
    """(word, n) of the words of at least so many letters and occurrences; tasks add up before they send."""

    run = re.compile(f"{LETTER}{{{letters},}}")  # shorter ones stay short

    def count(batches):
        held: Counter = Counter()

        def rows():
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update(runs_of(i, text, run))
                if len(held) >= held_words:
                    yield rows()
        if held:
            yield rows()

    counted = F.char_length("word") >= letters
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "word string, n long").filter(counted)
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# Zones


def _zone(m: Column, pre: Column, suf: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), pre.cast("int").alias("pre"), suf.cast("int").alias("suf"))


def _halves(m: Column, pre: Column, suf: Column) -> Column:
    """The two zones that a pair may differ in, of which the shorter word has ``m`` letters, ``pre`` and ``suf`` of them shared."""
    half = F.floor((m - pre - suf) / 2)
    return F.array(_zone(m, pre + half, suf), _zone(m, pre, m - pre - half))


def _keyed(rows: DataFrame, zones: Column) -> DataFrame:
    """A row (word, n, m, pre, suf, key, between) for each zone."""
    rows = rows.select("word", "n", F.explode(zones).alias("z")).select("word", "n", "z.*")
    length = F.char_length("word")
    shared = [F.substring("word", F.lit(1), F.col("pre")), F.substring("word", length - F.col("suf") + 1, F.col("suf"))]
    between = F.substring("word", F.col("pre") + 1, length - F.col("pre") - F.col("suf"))
    return rows.withColumns({"key": F.xxhash64("m", "pre", "suf", *shared), "between": between})


def zones(words: DataFrame, letters: int = LEAST_LETTERS, limit: int = LIMIT) -> DataFrame:
    """The rows of all lists, none of more than ``limit`` words unless its words differ in a single letter."""
    length = F.char_length("word")
    zero = F.lit(0)
    classes = F.filter(F.array(length, length - 1), lambda m: m >= letters)  # the word is the shorter one, or one longer
    pending = _keyed(words, F.flatten(F.transform(classes, lambda m: _halves(m, zero, zero))))
    parts = []
    while True:
        large = pending.filter(F.col("m") - F.col("pre") - F.col("suf") > 1).groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > limit)
        large = materialise(large.select("key"), "large-lists")
        if large.isEmpty():
            break
        parts.append(pending.join(large, "key", "left_anti"))
        split = pending.join(large, "key", "left_semi")
        pending = materialise(_keyed(split.select("word", "n", "m", "pre", "suf"), _halves(F.col("m"), F.col("pre"), F.col("suf"))), "zones")
    for part in parts:
        pending = pending.unionByName(part)
    return pending


# The scan


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    return i


def scan(words: list[str]) -> list[tuple[int, int]]:
    """Places (i, j), i < j, of the words of a sorted list that are at most one edit apart."""
    common = [0, *[shared_prefix(a, b) for a, b in zip(words, words[1:], strict=False)]]
    total, found = len(words), []
    for i, word in enumerate(words):
        n = len(word)
        # Row r has the distances of the first r letters of a listed word to the first r - 1, r and r + 1 of this one.
        rows = [(2, 0, 1 if n else 2)]
        j, known = i + 1, 0
        while j < total:
            other = words[j]
            r = min(known, common[j])
            del rows[r + 1 :]
            low, mid, high = rows[r]
            dead = 0
            for letter in other[r:]:
                # one letter of this word fewer, as many, one more
                low = min(low + (r == 0 or r > n or word[r - 1] != letter), mid + 1) if r <= n else 2
                mid = min(mid + (word[r] != letter), high + 1, low + 1) if r < n else 2
                high = min(high + (word[r + 1] != letter), mid + 1) if r + 1 < n else 2
                r += 1
                rows.append((low, mid, high))
                if low > 1 and mid > 1 and high > 1:
                    dead = r
                    break
            known = r
            if dead:
                # An edit is used up, so only the letters of this word about here can follow the prefix before.
                before, used = other[: dead - 1], rows[dead - 1]
                later = [word[k] for k, cost in zip(range(dead - 2, dead + 1), used, strict=True) if cost == 1 and 0 <= k < n and word[k] > other[dead - 1]]
                j = bisect_left(words, before + min(later), j + 1) if later else bisect_right(words, before + LAST, j + 1)
                continue
            if -1 <= n - r <= 1 and rows[r][n - r + 1] <= 1:
                found.append((i, j))
            j += 1
    return found


def _near(batches):
    """Pairs (a, n, b, m) of rows (key, m, pre, suf, between, word, n) in order."""
    key, group = None, []

    def pairs(group):
        out = []
        if len(group) > 1:
            for i, j in scan([g[0] for g in group]):
                (_, a, n, pre, suf), (_, b, m, _, _) = group[i], group[j]
                # Words of another list with the same hash are told apart here.
                if a != b and a[:pre] == b[:pre] and a[len(a) - suf :] == b[len(b) - suf :]:
                    out.append((a, n, b, m))
        return out

    def rows(found):
        a, n, b, m = zip(*found, strict=True)
        return pa.record_batch([pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(b, pa.string()), pa.array(m, pa.int64())], names=["a", "n", "b", "m"])

    found = []
    for batch in batches:
        for k, m, pre, suf, between, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (k, m, pre, suf) != key:
                found += pairs(group)
                key, group = (k, m, pre, suf), []
            group.append((between, word, n, pre, suf))
        while len(found) >= 10_000:
            yield rows(found[:10_000])
            del found[:10_000]
    found += pairs(group)
    if found:
        yield rows(found)


def near_words(words: DataFrame, letters: int = LEAST_LETTERS, limit: int = LIMIT) -> DataFrame:
    """Distinct (a, n, b, m): the pairs of (word, n) that are one edit apart, each once."""
    order = ["key", "m", "pre", "suf", "between", "word"]
    lists = zones(words, letters, limit).repartition("key").sortWithinPartitions(*order).select(*order, "n")
    found = lists.mapInArrow(_near, "a string, n long, b string, m long")
    swap = F.col("b") < F.col("a")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("n", "m"), ("b", "a"), ("m", "n"))]
    return found.select(*ends).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; pointers are doubled until none moves."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialise(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 2, **options) -> DataFrame:
    """A row for each word: its form (the commonest near word, if ``ratio`` times as common), root and numbers."""
    arrow_batches(docs.sparkSession)
    words = materialise(vocabulary(docs, id_col, text_col), "vocabulary")
    pairs = materialise(near_words(words, **options), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("m").alias("n"), F.col("a").alias("b"), F.col("n").alias("m")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min_by(F.struct("b", "m"), F.struct(-F.col("m"), F.col("b"))).alias("best"))
    is_form = F.col("best.m") >= ratio * F.col("n")
    joined = words.join(best, "word", "left").select("word", F.when(is_form, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.m")).alias("form_n"))
    joined = materialise(joined, "forms")
    found = roots(joined.filter("form IS NOT NULL"))
    return joined.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return variants(docs)
