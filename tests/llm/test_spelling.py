"""Spelling variants against a plain version that compares all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.llm import spelling
from cairn.session import table

DATA = "/root/testdata/sf0.001"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def vocabulary(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain(docs):
    words = vocabulary(docs)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    rows = {}
    for w, n in words.items():
        near = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        rows[w] = (form, n, len(near), words[form] if form else None)
    out = set()
    for w, (form, n, near, form_n) in rows.items():
        root = w
        while rows[root][0] is not None:
            root = rows[root][0]
        out.add((w, form, root, n, near, form_n))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def found(df, **options):
    got = [tuple(r[c] for c in COLUMNS) for r in spelling.variants(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_table(spark):
    docs = table(spark, DATA, "documents")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = spelling.op11_spelling_variants(spark, docs)
    assert got.columns == COLUMNS
    assert {tuple(r) for r in got.collect()} == want
    assert sum(r[1] is not None for r in want) > 20


@pytest.mark.parametrize("seed", range(3))
def test_crowded_words(spark, seed):
    """Few letters, so that words have many near ones; lists are split down to single letters."""
    r = random.Random(seed)
    stem = "".join(r.choice("ab") for _ in range(6))
    words = ["".join(r.choice("abé") for _ in range(r.randint(4, 7))) for _ in range(400)] + [stem + "".join(r.choice("abc") for _ in range(r.randint(0, 4))) for _ in range(300)] + ["x" * n for n in range(4, 40)]
    docs = [(r.choice([None, 1, 2, 3, 10**12]), " ".join(r.choices(words, [r.random() ** 4 for _ in words], k=400))) for _ in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, limit=20) == found(df) == plain(docs)


def test_odd_rows(spark):
    long = "abcdefghij" * 3000
    docs = [(1, None), (2, ""), (None, "Colour colour COLOUR colours"), (3, "colour color color colors color-colors ×÷×÷×ß"), (3, "colour color color colors color-colors ×÷×÷×ß"), (4, "ab " * 9), (5, f"{long} {long} {long} {long}x {long}x {long}x"), (6, "ÀÉÎÕÜ àéîõü àéîõü àéîõü ÀÉÎÕÜ ÀÉÎÕÜ")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int")
    want = plain(docs)
    assert found(df) == want and any(w == long for w, *_ in want)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.op11_spelling_variants(spark, df).collect() == []
    assert found(spark.createDataFrame([(1, None)], "doc_id long, text string")) == set()


def test_ties_and_chains(spark):
    docs = [(1000 + i, w) for w, n in [("abcdef", 3), ("abcdeg", 7), ("abcdeh", 7), ("abcdxg", 20), ("abyyxg", 50), ("abcyxg", 41)] for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain(docs)
    assert found(df) == want
    assert len({w[2] for w in want}) < len(want)


def test_lists_are_bounded(spark):
    words = spark.range(3000).select(F.concat(F.lit("samestart"), F.conv("id", 10, 4), F.lit("sameend")).alias("word"), F.lit(3).cast("long").alias("n"))
    lists = spelling.zones(words, limit=50).filter("m - pre - suf > 1").groupBy("key").count()
    assert lists.agg(F.max("count")).first()[0] <= 50


@pytest.mark.parametrize("seed", range(20))
def test_scan(seed):
    r = random.Random(seed)
    for _ in range(50):
        letters = "abcé"[: r.randint(1, 4)]
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 30))})
        assert spelling.scan(words) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]
