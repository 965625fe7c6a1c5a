"""Exact, line, passage and near deduplication against brute force, and odd rows."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, line_dedup, near_dedup, substring_dedup

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
#: Null texts and identifiers, empty texts, repeated rows, ties.
ODD = [(1, None, "en"), (2, "", "en"), (3, "Same Text", "en"), (4, "same text", None), (4, "same text", None), (None, "SAME TEXT", "de"), (5, "ünïcode ÀÉ", "fr"), (6, "ünïcode Àé", "fr"), (None, None, None)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def random_words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# Exact


def test_exact_odd_rows(spark):
    got = exact_dedup.op6_exact_dedup(spark, spark.createDataFrame(ODD, DOCS)).collect()
    assert len(got) == len(ODD)
    by_text = {}
    for i, t, _ in ODD:
        by_text.setdefault(sha(lower(t)), []).append(i)
    for r in got:
        ids = by_text[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    for digest in by_text:
        assert sum(r["kept"] for r in got if r["text_sha256"] == digest) == 1


def test_exact_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.op6_exact_dedup(spark, empty).count() == 0
    clash = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, keep_id int, digest string")
    kept = exact_dedup.mark_exact(clash, keep="smallest").filter("kept").select("row.*").collect()
    assert [tuple(r) for r in kept] == [(1, "a", 5, "x")]


def test_exact_batches_flush_and_compact(spark):
    index = exact_dedup.DigestIndex(spark, keep="smallest", fanout=2, memtable_rows=2)
    for k in range(5):
        index.add(spark.createDataFrame([(10 * k + j, bytearray(f"digest {j}".encode())) for j in range(4)], "id long, digest binary"))
    assert any(index.levels[1:])
    assert sorted((r["best"], r["n"], r["ties"]) for r in index.entries().collect()) == [(0, 5, 1), (1, 5, 1), (2, 5, 1), (3, 5, 1)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_come_from_the_compacted_index(spark, monkeypatch, keep):
    compacted = []
    write = exact_dedup.DigestIndex._write
    monkeypatch.setattr(exact_dedup.DigestIndex, "_write", lambda self, run, level: (compacted.append(level), write(self, run, level)))
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), f"text {rng.randrange(12)}") for _ in range(150)]
    got = exact_dedup.mark_exact(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep).collect()
    assert max(compacted) > 0
    for r in got:
        ids = [i for i, t in rows if t == r["row"]["text"]]
        best = (max if keep == "largest" else min)(ids, key=lambda i: -1 if i is None else i)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
    assert sum(r["kept"] for r in got) == len({t for _, t in rows})
    # Without what compaction merges, groups are torn.
    monkeypatch.setattr(exact_dedup.DigestIndex, "_merge", lambda self, runs: runs.dropDuplicates(["digest"]))
    torn = exact_dedup.mark_exact(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep).collect()
    assert sorted(r["group_size"] for r in torn) != sorted(r["group_size"] for r in got)


@pytest.mark.parametrize("digest", [lambda raw: hashlib.sha256(raw).digest()[:1] if raw > b"m" else b"", lambda raw: b"x"])
def test_exact_collision_is_told_apart_by_bytes(spark, digest):
    rows = [(i, t) for i, t in enumerate(["a", "a", "b", "b", "c", "zz", "ZZ", "é"])] + [(7, "é"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.mark_exact(docs, digest=digest).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    want = [(0, 0, 2, True), (1, 0, 2, False), (2, 2, 2, True), (3, 2, 2, False), (4, None, 2, False), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 2, True), (7, 7, 2, False), (None, None, 2, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_full_filter_and_long_texts(spark):
    rows = [(i, f"{i % 30} " + "long text " * 100_000 if i < 4 else f"text {i % 30}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, max(j for j, u in rows if u == t), sum(u == t for _, u in rows)) for i, t in rows)
    got = exact_dedup.mark_exact(df, keep="largest", max_filter_bits=1).select("row.doc_id", "keep_id", "group_size").collect()
    assert sorted(map(tuple, got)) == want


# Lines


def brute_lines(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    where = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(strip))
            if len(key) >= min_chars:
                where.setdefault(key, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(where.get(lower(x.strip(strip)), ())) < min_docs or max(where[lower(x.strip(strip))]) == i]
        out.append((i, len(lines), len(lines) - len(left), sha("\n".join(left))))
    return sorted(out)


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    shared = ["  Shared LINE number %d with enough characters in it to count\t" % k for k in range(6)] + ["é" * 39, "é" * 40, "short"]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.5 else " ".join(random_words(rng, 9)) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(100, None), (101, "")]
    got = line_dedup.op1_line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_lines(rows)


def test_lines_odd_rows(spark):
    long = "a line that is long enough to be counted as a line"
    rows = [(1, long, 0), (1, long, 0), (2, long, 0), (None, long, 0), (3, long, 0), (4, long + "\nrest", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {(r["row"]["doc_id"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(df, min_docs=5).collect()}
    assert got == {(1, 1, ""), (2, 1, ""), (None, 1, ""), (3, 1, ""), (4, 0, long + "\nrest")}
    assert line_dedup.op1_line_dedup(spark, df.limit(0)).count() == 0


def test_line_index_gives_a_line_to_the_batch_that_had_it_first(spark):
    index = line_dedup.LineIndex(spark, fanout=2)
    for batch in ([(9, b"a"), (8, b"a"), (8, b"b")], [(6, b"b"), (5, b"c")], [(3, b"a"), (2, b"d")], [(1, b"c")]):
        index.add(spark.createDataFrame(batch, "doc long, key binary"))
    assert any(index.levels[1:])
    assert {bytes(r["key"]): (r["n_docs"], r["keeper"]) for r in index.entries().collect()} == {b"a": (3, 9), b"b": (2, 8), b"c": (2, 5), b"d": (1, 2)}
    names = index.runs()
    index.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_lines_need_the_anti_join(spark, monkeypatch):
    rows = [(i, "\n".join(f"a line number {k} that is long enough to be counted" for k in range(i % 7))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.op1_line_dedup(spark, df).collect())) == brute_lines(rows)
    # Without it every batch takes its lines for new.
    monkeypatch.setattr(line_dedup.LineIndex, "_mark", lambda self, counted: counted.select("key", "n_docs", F.col("max_doc").alias("keeper")))
    assert sorted(map(tuple, line_dedup.op1_line_dedup(spark, df).collect())) != brute_lines(rows)


def test_lines_long_texts_and_repeated_null_rows(spark):
    long = "a line that is long enough to be counted as a line"
    rows = [(i, "\n".join([f"{k} {'x' * 60}" for k in range(20_000)] + [long])) for i in range(2)] + [(None, long)] * 50 + [(7 + i, long) for i in range(3)] + [(None, f"{long}\nother {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("key", F.lit(2))
    got = line_dedup.op1_line_dedup(spark, df).collect()
    assert len(got) == len(rows)
    # Six documents hold the line: 0, 1, 7, 8, 9 and the one without an identifier.
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"]) for r in got) == sorted(
        [("0", 20_001, 1), ("1", 20_001, 1), ("7", 1, 1), ("8", 1, 1), ("9", 1, 0)] + [("None", 1, 1)] * 50 + [("None", 2, 1)] * 5
    )


# Passages


def brute_passages(rows, window=20):
    first = {}
    split = [(i, [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]) for i, t in rows]
    for i, w in sorted(split, key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def test_passages_equal_brute_force(spark):
    rng = random.Random(9)
    passages = [random_words(rng, n) for n in (20, 21, 35, 60, 19)]
    rows = []
    for i in range(50):
        words = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            words += random_words(rng, rng.randrange(12)) + (p if rng.random() < 0.6 else p[a:])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (70, None), (71, ""), (72, "x " * 70), (73, "\x1c  " * 30)]
    got = substring_dedup.op8_substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_passages(rows)


def test_passages_small_shards_give_the_same(spark):
    rng = random.Random(2)
    p = random_words(rng, 70)
    rows = [(i, " ".join(random_words(rng, 10) + p[rng.randrange(30) :])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.dedup_passages(df, max_phrases=10, max_bytes=500, digest_only=True)
    assert sorted(map(tuple, got.collect())) == brute_passages(rows)


def test_passages_odd_rows(spark):
    text = " ".join(f"word{k}" for k in range(25))
    rows = [(1, text), (1, text), (None, text), (2, text + " end"), (3, "few words")]
    got = substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in got.collect()) == [
        ("1", 25, ""), ("1", 25, ""), ("2", 25, "end"), ("3", 0, "few words"), ("None", 0, text)
    ]
    assert substring_dedup.dedup_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_need_the_automata(spark, monkeypatch):
    rng = random.Random(7)
    shared = random_words(rng, 60)
    rows = [(i, " ".join(random_words(rng, 15) + shared[rng.randrange(20) :] + random_words(rng, 5))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(map(tuple, substring_dedup.op8_substring_dedup(spark, df).collect()))
    assert got == brute_passages(rows)

    # Phrases that no automaton finds leave every window where it is.
    monkeypatch.setattr(substring_dedup, "locate", lambda words, phrases, most: np.zeros(0, np.int64))
    judged = substring_dedup._judge_local([0], 10, 10)
    batch = pa.record_batch([pa.array([0, 1]), pa.array([0, 1]), pa.array([t for _, t in rows[:2]]), pa.array([[b"x"], [b"x"]], pa.list_(pa.binary()))], names=["d", "t", "text", "p"])
    assert sum(b.num_rows for b in judged(iter([batch]))) == 0


def test_automata_find_every_occurrence_of_phrases_that_other_texts_cut_out():
    rng = random.Random(3)
    texts = [" ".join(random_words(rng, 90, 3)) for _ in range(6)] + ["", "w1  w2\t" * 30, None]
    words = substring_dedup.Words(texts)
    phrases = sorted({b" ".join(t.encode().split()[k : k + 8]) for t in texts[:3] for k in range(0, 80, 9)})
    want = []
    for d, t in enumerate(texts):
        split = (t or "").encode().split()
        want += [words.first[d] + k for k in range(len(split) - 7) if b" ".join(split[k : k + 8]) in phrases]
    for most in (3, 1000):
        assert substring_dedup.locate(words, phrases, most).tolist() == want


def test_passages_long_texts_clashing_columns_and_shared_identifiers(spark):
    rng = random.Random(1)
    p = random_words(rng, 40)
    long = random_words(rng, 60_000, 10**6)
    rows = [(1, " ".join(long + p)), (2, " ".join(p + long[1000:31_000])), (3, "x " + " ".join(p)), (4, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("tag", F.lit(1)).withColumn("digest", F.lit(None).cast("string"))
    assert sorted(map(tuple, substring_dedup.op8_substring_dedup(spark, df).collect())) == brute_passages(rows)
    # Two texts without an identifier, and two under one: none of such a pair is earlier than the other at the same start.
    same = [(None, " ".join(p)), (None, " ".join([*p, "end"])), (7, " ".join([*p, "a"])), (7, " ".join([*p, "b"]))]
    got = substring_dedup.dedup_passages(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == [("7", 41, 40), ("7", 41, 40), ("None", 40, 0), ("None", 41, 0)]


# Near duplicates


def test_passages_with_long_words_that_differ(spark):
    """Words of 300 to 5,000 bytes that trade bytes between places far apart are different words."""
    r = random.Random(8)
    same = [f"w{i}" for i in range(19)]
    a, b = bytearray(b"a" * 600), bytearray(b"a" * 600)
    a[5], b[261] = ord("b"), ord("b")
    docs = [(1, " ".join([*same, a.decode()])), (2, " ".join([*same, b.decode()]))]
    for k in range(3, 9):
        n = r.choice([300, 2048, 5000])
        word = bytearray(b"c" * n)
        word[r.randrange(n)] = ord("d")
        docs += [(10 * k + j, " ".join([*same[:12], word.decode() if j < 2 else "c" * n, *same[2:]])) for j in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring_dedup.op8_substring_dedup(spark, df).collect()}
    want = {x[0]: tuple(x[1:3]) for x in brute_passages(docs)}
    assert got == want and got[1] == (20, 0) and got[2] == (20, 0)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_plain_one():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.randrange(4) for _ in range(rng.randrange(15))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        limit = rng.randrange(8)
        assert near_dedup.distance_within(a, b, limit) == min(plain_distance(a, b), limit + 1)


def brute_classes(rows):
    words = {i: near_dedup.WORD.findall((t or "").encode().lower()) for i, t in rows}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(words)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if words[a] and words[b] and near_dedup.similar(words[a], words[b], 0.8):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = random_words(rng, rng.choice([4, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(max(0, int(len(copy) * rng.random() * 0.06))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = random_words(rng, rng.randrange(3))
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "!!"), (903, rows[0][1].upper())]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op10_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_recall_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == brute_classes(rows)


def test_near_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, 1), (5, text, 1), (None, text, 2), (7, text + " eleven", 3), (8, "other", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = near_dedup.near_classes(df.drop("class_id")).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == [("5", "None"), ("5", "None"), ("7", "None"), ("8", "8"), ("None", "None")]
    assert near_dedup.near_classes(df.limit(0)).count() == 0


def test_near_long_texts_and_clashing_columns(spark):
    rng = random.Random(2)
    long = random_words(rng, 50_000, 10**6)
    near = [w if k % 9 else "other" for k, w in enumerate(long)]
    far = [w if k % 3 else "other" for k, w in enumerate(long)]
    rows = [(3, " ".join(long)), (1, " ".join(near)), (2, " ".join(far)), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("doc", "row", "node", "size", "keys", "bag", "class_id", "whole", "stays"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(map(tuple, near_dedup.near_classes(df).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]
    kept = near_dedup.drop_near(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]


def test_near_texts_without_or_with_shared_identifiers(spark):
    rng = random.Random(6)
    base = [random_words(rng, 40) for _ in range(6)]
    near = [[*b[:20], "other", *b[21:]] for b in base]
    # Three texts without an identifier, three texts under 5; each has a near copy of its own.
    rows = [(None if i < 3 else 5, " ".join(b)) for i, b in enumerate(base)] + [(10 + i, " ".join(n)) for i, n in enumerate(near)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, None)] * 3 + [(5, 5)] * 3 + [(10 + i, None if i < 3 else 5) for i in range(6)]
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))


@pytest.mark.parametrize("seed", range(2))
def test_near_variants_meet_through_a_base_that_is_not_the_least(spark, seed):
    rng = random.Random(seed)
    shared, base = random_words(rng, 40), random_words(rng, 60)

    def variant(part):
        out = list(part)
        for at in rng.sample(range(len(out)), 12):  # 0.88 to the base, about 0.78 to each other
            out[at] = f"v{rng.randrange(10**9)}"
        return out

    # Before the passage that all share, variants of the base and other texts; the base stands in between.
    rows = [(i, " ".join([*(variant(base) if i % 2 else random_words(rng, 60)), *shared])) for i in range(120)]
    rows[71] = (71, " ".join([*base, *shared]))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == brute_classes(rows)


def test_all_pairs_of_a_key_meet_once_in_small_cells(spark):
    rng = random.Random(5)
    # Texts of 10 words have the 32 keys of the first tier; many texts share the first few of them.
    sketch = lambda: [(1 << 40) + 1000 * i + rng.choice([0, 0, 1, rng.randrange(2, 900)]) for i in range(32)]
    keys = {doc: sketch() for doc in range(60)}
    group = {doc: doc % 7 for doc in keys}
    rows = [(k, doc, group[doc], 10) for doc, ks in keys.items() for k in ks]
    want = {(a, b) for a in keys for b in keys if a < b and group[a] != group[b] and set(keys[a]) & set(keys[b])}
    df = spark.createDataFrame(rows, "key long, doc long, group long, size int")
    packed = [(doc, bytearray(near_dedup.BAGS[0] // 2), bytearray(np.array(ks, np.uint64).tobytes())) for doc, ks in keys.items()]
    bags = spark.createDataFrame(packed, "doc long, bag binary, keys binary")
    near_dedup.arrow_batches(spark, 7)
    assert {tuple(r) for r in near_dedup.all_edges(df, bags, cell=4).collect()} == want
    marks = {d: near_dedup.marks_in([np.array(ks, np.uint64).astype(np.uint32).tobytes()], np.array([10]), d) for d, ks in keys.items()}
    for a, b in want:
        met = [k for k in set(keys[a]) & set(keys[b]) if near_dedup.first_meeting(marks[a], marks[b], np.array([k], np.uint64))[0]]
        assert met == [min(set(keys[a]) & set(keys[b]))]


def test_signatures_never_rule_out_a_similar_pair():
    rng = random.Random(11)
    texts, edits = [], []
    for n in [3, 10, 40, 64, 65, 130, 300, 700, 2000, 6000] * 12:
        a = random_words(rng, n, rng.choice([5, 50, 4000]))
        b, d = list(a), rng.randrange(int(n * 0.2) + 1)
        for _ in range(d):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = random_words(rng, rng.randrange(2))
        texts += [" ".join(a).encode(), " ".join(b).encode()]
        edits.append(d)
    bags = near_dedup.bag(texts)
    even = np.arange(0, len(texts), 2)
    n = np.array([len(t.split()) for t in texts])
    assert near_dedup.can_be_similar(even, even + 1, bags, np.maximum(n[even], n[even] + np.array(edits)), 0.8).all()
    # Other texts of the same length do not pass.
    far = near_dedup.bag([" ".join(random_words(rng, 700, 10**6)).encode() for _ in range(40)])
    x = np.arange(0, 40, 2)
    assert not near_dedup.can_be_similar(x, x + 1, far, np.full(20, 700), 0.8).any()


def test_near_similarity_is_a_parameter(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], *[f"x{i}" for i in range(10)]])), (3, " ".join(words[:29]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity, want in ((0.7, [(1, 1), (2, 1), (3, 1)]), (0.8, [(1, 1), (2, 2), (3, 3)])):
        assert sorted(map(tuple, near_dedup.near_classes(df, similarity=similarity).collect())) == want


def test_near_recall_by_length():
    """The chance to share a key if the most words that similarity 0.8 allows are changed, far apart."""
    for n in [*range(5, 400), 1000, 5000, 20000]:
        d = int(n * 0.2 + 1e-9)
        # n and n words, d changed; n - d and n words, d inserted.
        for a, lost in ((n, 2), (n - d, 1)):
            miss = 1.0
            for tier in near_dedup.TIERS:
                if tier.least <= a and n <= tier.most:
                    mine, other = a - tier.k + 1, n - tier.k + 1
                    same = mine - d * (tier.k if lost == 2 else tier.k - 1)
                    if same >= tier.sampled:
                        miss *= (1 - math.comb(same, tier.sampled) / math.comb(mine + other - same, tier.sampled)) ** tier.sketches
            assert miss < 0.01, (n, a)


@pytest.mark.parametrize("n", [5, 6, 8, 10, 11, 15, 16, 20, 40, 64, 65, 80, 81, 150, 400])
def test_near_sketches_find_texts_at_the_limit(n):
    rng = random.Random(n)
    texts, pairs = [], 1000 if n < 100 else 300
    for _ in range(pairs):
        a = random_words(rng, n, 10**6)
        b, d = list(a), int(n * 0.2)
        for i in range(d):
            b[(2 * i + 1) * n // (2 * d)] = "changed" + str(rng.randrange(10**6))
        texts += [" ".join(a).encode(), " ".join(b).encode()]
    keys = [set(memoryview(k).cast("Q")) for k in near_dedup.sketch(texts)[0]]
    assert sum(bool(keys[i] & keys[i + 1]) for i in range(0, len(keys), 2)) >= 0.985 * pairs


@pytest.mark.parametrize("op", [exact_dedup.op6_exact_dedup, line_dedup.op1_line_dedup, substring_dedup.op8_substring_dedup, near_dedup.op10_near_dedup])
def test_one_row_a_document(spark, op):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = op(spark, docs)
    assert got.count() == docs.count()
    assert got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    assert got.filter(F.col("doc_id").isNull()).count() == 0
