"""The n-gram join against a plain version that compares all sets with all."""

import random
import re

import duckdb
import numpy as np
import pytest

from cairn.llm import ngram_join
from cairn.session import table

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def plain(docs, percent=80):
    """Rows (doc_id, n_shingles, component_id), sorted; a null identifier is the least."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    rank = lambda x: (x is not None, x)
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc), doc, key=rank)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in ngram_join.similar_groups(df, **options).collect()), key=str)


def test_table(spark):
    docs = table(spark, DATA, "documents")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = ngram_join.op13_ngram_join(spark, docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(d != c for d, _, c in want) > 5


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({ngram_join.ORACLE_SQL})").fetchall(), key=str)
    assert found(table(spark, DATA, "documents")) == want


@pytest.mark.parametrize("seed", range(3))
def test_edited_texts(spark, seed, monkeypatch):
    """Chains of edits around the threshold, of few words and many, under passages that most texts share."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = r.choices(words, k=60)
    docs = []
    for _ in range(8):
        base = r.choices(words, k=r.choice([1, 3, 5, 6, 9, 12, 30, 90, 250]))
        if r.random() < 0.5:
            base = base + shared
        for _ in range(r.randint(1, 14)):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(text) // 40))):
                at = r.randrange(len(text) + 1)
                text[at : at + r.randint(0, 2)] = r.choices(words, k=r.randint(0, 2))
            docs.append((r.choice([None, *range(200)]), " ".join(text).upper() if r.random() < 0.2 else "\n ".join(text)))
            if r.random() < 0.3:
                base = text
    monkeypatch.setattr(ngram_join, "CHUNK", 50)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    want = plain(docs)
    assert found(df) == want
    assert found(df, max_broadcast_ids=0) == want
    assert found(df, percent=50) == plain(docs, 50)


def test_every_pair_meets_without_stars(spark, monkeypatch):
    """With no first round the tiles alone find all links; cells are small, so that a key has several in a band."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = r.choices(words, k=120)
    docs = []
    for i in range(150):
        text = list(base) + r.choices(words, k=r.randint(0, 20))
        for _ in range(r.randint(0, 4)):
            text[r.randrange(len(text))] = r.choice(words)
        docs.append((i, " ".join(text)))
    whole = ngram_join.tile_edges
    monkeypatch.setattr(ngram_join, "star_edges", lambda rows, percent: rows.selectExpr("doc AS a", "doc AS b").limit(0))
    monkeypatch.setattr(ngram_join, "tile_edges", lambda rows, maps, percent: whole(rows, maps, percent, cell=10, few=r.choice([0, 20])))
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == plain(docs)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = [(1, None), (2, ""), (None, None), (3, " \t\n"), (4, "a b c d"), (5, "A B\tC D"), (5, "a b c d"), (5, "a b c"), (None, "a b c"), (6, "a b c d e"), (7, "x" * 5000 + " b c d e"), (8, "x" * 5001 + " b c d e"), (9, long), (10, long + " end"), (-3, long.upper()), (11, "é b c d e f"), (12, "é b c d e f")]
    df = spark.createDataFrame([(*d, "n", b"k") for d in docs], "doc_id long, text string, size string, keys binary")
    assert found(df) == plain(docs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert found(df) == []
    assert found(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")) == [(1, 0, 1), (None, 0, None)]


def test_bounds():
    """No pair that links fails the bitmap, and its sets share a key among the first of either."""
    r = np.random.default_rng(1)
    counts = r.integers(0, 9, 1 << 10).astype(np.uint32)
    for _ in range(300):
        n = int(r.integers(1, 400))
        base = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        more = np.unique(r.integers(0, 1 << 63, int(r.integers(0, n // 4 + 2))).astype(np.uint64))
        other = np.union1d(base[: len(base) - int(r.integers(0, len(base) // 5 + 1))], more)
        if not len(other):
            continue
        links = ngram_join.linked(base, other, 80)
        if links:
            assert ngram_join.can_link(np.array([0]), np.array([1]), [ngram_join.bitmap(base), ngram_join.bitmap(other)], np.array([len(base), len(other)]), 80)[0]
            small, large = sorted((base, other), key=len)
            first, low, _ = ngram_join.keys_of(small, counts)
            second, _, _ = ngram_join.keys_of(large, counts)
            assert np.intersect1d(first[:low], second).size
