"""Language ID, classifiers, decontamination, BPE and WARC."""

import gzip
import hashlib
import json
import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from cairn.llm import bpe, calibrate, decontaminate, language_id, quality, toxicity, warc

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Language ID


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.op2_language_id(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "123 ... !!", "en"), (103, "the dog " * 200_000, None), (104, "chien", None), (104, "chien", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lid", F.lit(1))
    got = {}
    for r in language_id.op2_language_id(spark, df).collect():
        got[r["doc_id"]] = (r["lang_pred"], r["score"])
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en"
    assert got[104][0] == "fr"
    assert language_id.op2_language_id(spark, df.limit(0)).count() == 0


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.op2_language_id(spark, df).first()["lang_pred"] == "und"


def plain_bits(train, text):
    """Code length of ``text`` by PPM with method C and exclusion, byte by byte."""
    fold = lambda t: b"   " + bytes(language_id.FOLD[b] for b in t.encode())
    seen = defaultdict(Counter)
    for t in train:
        b = fold(t)
        for i in range(3, len(b)):
            for k in range(4):
                seen[b[i - k : i]][b[i]] += 1
    b, bits = fold(text), 0.0
    for i in range(3, len(b)):
        excluded = set()
        for k in (3, 2, 1, 0):
            counts = {x: n for x, n in seen[b[i - k : i]].items() if x not in excluded}
            whole = sum(counts.values()) + len(counts)
            if b[i] in counts:
                bits -= math.log2(counts[b[i]] / whole)
                break
            bits -= math.log2(len(counts) / whole) if counts else 0
            excluded |= set(counts)
        else:
            bits += math.log2(max(1, language_id.SYMBOLS - len(excluded)))
    return bits


def plain_orders(texts):
    """The nodes of each order, from {language: texts}."""
    rows = {lang: [g for t in ts for g in language_id.own_grams([t]).tolist()] for lang, ts in texts.items()}
    out = []
    for size in (4, 3, 2, 1):
        counts = [(k, g, n) for k, lang in enumerate(sorted(rows)) for g, n in Counter(g & (1 << 8 * size) - 1 for g in rows[lang]).items()]
        out.append(tuple(np.array(c) for c in zip(*counts, strict=True)))
    return out


LANG_TEXTS = {"a": ["abracadabra " * 3, "the cat 1234 é sat"], "b": ["banana bandana", "ünïcode ж Ωmega"]}
PROBES = ["banana", "abra cadabra", "zzz é жж 字", "the the", "Ωж", "b"]


def test_code_lengths_equal_plain_ppm_in_blocks_of_any_size(monkeypatch):
    trees = language_id.Trees(["a", "b"], plain_orders(LANG_TEXTS))
    want = [[plain_bits(LANG_TEXTS[x], p) for x in "ab"] for p in PROBES]
    assert np.allclose(trees.total_bits(PROBES), want, rtol=1e-4)
    monkeypatch.setattr(language_id, "BLOCK", 5)
    assert np.allclose(trees.total_bits(PROBES), want, rtol=1e-4)
    context = language_id.grams_of(np.frombuffer(b"ban\0", np.uint8))
    every = np.array([context[0] | x for x in sorted(set(language_id.FOLD.tolist()))], np.uint32)
    assert np.allclose(np.exp2(-trees.code_lengths(every)).sum(axis=0), 1, atol=1e-4)


def test_language_query_equals_plain_ppm(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["der", "die", "und", "ñandú", "ж字", "le", "chat"][x : x + 4]) for _ in range(12)), "abc"[x]) for i, x in enumerate([0, 1, 2] * 30)]
    texts += [(200, "½²①", None), (201, "字", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    learned = {x: [t for i, t, la in texts if la == x and zlib.crc32(str(i).encode()) % 5] for x in "abc"}
    for r in language_id.op2_language_id(spark, df).collect():
        text = dict((i, t) for i, t, _ in texts)[r["doc_id"]]
        bits = [plain_bits(learned[x], text) for x in "abc"]
        if r["doc_id"] == 200:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == "abc"[bits.index(min(bits))]
            assert r["score"] == pytest.approx(1 / sum(2 ** (min(bits) - b) for b in bits), abs=1e-3)


def test_trees_in_zones_say_the_same(spark):
    rng = random.Random(3)
    junk = ["".join(rng.choice("bcdfghjklmnp ") for _ in range(40)) for _ in range(60)]
    rows = [("big", "the quick brown fox jumps over the lazy dog " * 9)] * 5 + [("big", x) for x in junk] + [("rare", "съешь ещё этих мягких французских булок")]
    learned = {x: [t for la, t in rows if la == x] for x in ("big", "rare")}
    df = spark.createDataFrame(rows, "lang string, text string")
    texts = [(i, t) for i, t in enumerate(["мягких булок", "quick fox", "жук", "nfgb mlk", None, "", "½²", "the " * 3000, junk[0], "日本 x"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("bits", F.lit("clash"))
    whole, cut = language_id.train(df), language_id.train(df, max_cells=1000)
    assert len(whole.zones) == 1 and len(cut.zones) > 4
    assert cut.zones[0][0] == 0 and cut.zones[-1][1] == 0xFFFF and all(a[1] + 1 == b[0] for a, b in zip(cut.zones, cut.zones[1:], strict=False))
    nodes = {g for t in learned["big"] + learned["rare"] for g in language_id.own_grams([t]).tolist()}
    assert len(whole.trees((0, 0xFFFF)).known.keys) == len(nodes) + 1  # every node is there
    assert max(len(cut.trees(z).known.keys) for z in cut.zones) < 600
    for forest in (whole, cut):
        got = {r["doc_id"]: r["lid"] for r in language_id.identify(docs, forest).select("row.doc_id", "lid").collect()}
        for i, t in texts:
            if t is None or not language_id.LETTER.search(t):
                assert tuple(got[i]) == ("und", 0.0)
            else:
                bits = [plain_bits(learned[x], t) for x in ("big", "rare")]
                assert got[i]["lang_pred"] == ("big", "rare")[bits.index(min(bits))], t
                assert got[i]["score"] == pytest.approx(1 / sum(2 ** -min(b - min(bits), 1000) for b in bits), abs=1e-3)
    assert language_id.identify(docs.limit(0), cut).count() == 0


def test_languages_stay_when_the_corpus_is_repeated(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("lang", "text")
    once, ten = (language_id.identify(docs, language_id.train(x)) for x in (rows, rows.crossJoin(spark.range(10)).drop("id")))
    got = [{r["doc_id"]: r["lang_pred"] for r in x.select("row.doc_id", "lid.lang_pred").collect()} for x in (once, ten)]
    assert got[0] == got[1]


def test_more_than_64_languages_and_scripts(spark):
    rows = [(f"l{k:03}", " ".join(chr(0x4E00 + 40 * k + j) for j in range(40))) for k in range(90)]
    trees = language_id.train(spark.createDataFrame(rows, "lang string, text string")).trees((0, 0xFFFF))
    assert len(trees.langs) == 90
    assert trees.predict([t for _, t in rows])[0] == [x for x, _ in rows]


# Classifiers


@pytest.mark.parametrize(("op", "label", "least"), [(quality.op5_quality, "quality", 0.97), (toxicity.op3_toxicity, "toxic", 0.975)])
def test_classifier_on_held_out_rows(spark, op, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = op(spark, docs, labels)
    known = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r[label] for r in known) / len(known) > least
    assert got.count() == docs.count()


@pytest.mark.parametrize("op", [quality.op5_quality, toxicity.op3_toxicity])
def test_classifier_odd_rows(spark, op):
    rows = [(i, "good text here" if i % 2 else "BAD!! worthless junk ###") for i in range(40)] + [(50, None), (51, ""), (52, "x" * 300_000), (52, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (999, 1, 0)], LABELS)
    got = {r["doc_id"]: r["score"] for r in op(spark, docs, labels).collect()}
    assert len(got) == 43
    assert all(0 <= v <= 1 for v in got.values())
    assert got[50] == got[51]
    assert op(spark, docs.limit(0), labels).count() == 0
    assert {r["score"] for r in op(spark, docs, labels.limit(0)).collect()} == {0.5}


def edits(a, b):
    """Least number of characters wrong, missing, too many or swapped with the next one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1]


def plain_near(terms, allowed, word):
    """{term: edits} of the terms within their edits of the word, stems of its beginning."""
    found = {}
    for i, ((term, stem, _), k) in enumerate(zip(terms, allowed, strict=True)):
        if stem:
            far = edits(term, word[: len(term) + k])
            d = far[-1] if k == 0 and len(word) <= len(term) else min(edits(term, word[:m])[-1] for m in range(len(term) + k + 1))
        else:
            d = edits(term, word)[-1] if abs(len(term) - len(word)) <= k else k + 1
        if d <= k:
            found[i] = d
    return found


def plain_search(terms, allowed, word):
    """The term that weighs most in the word, by the edit distance to each."""
    hits = [(terms[i][2] * toxicity.MISSPELLED**d, -i) for i, d in plain_near(terms, allowed, word).items()]
    weight, i = max(hits, default=(0.0, 1))
    return -i, weight


@pytest.mark.parametrize("states", [50_000, 20])
def test_lexicon_search_equals_edit_distance(states):
    terms = [("idiot", False, 2.0), ("clown", False, 3.0), ("scum", False, 1.0), ("achli", True, 1.5), ("crétin", False, 2.5), ("дурак", True, 1.0), ("downright", False, 2.0)]
    rng = random.Random(1)
    words = ["idiot", "idot", "idioot", "ldiot", "idito", "clowns", "scum", "scun", "achlichen", "achl", "own", "cretin", "crètin", "дурачок", "дурка", "x" * 99, "downrigth", "donwrigth", ""]
    words += ["".join(rng.choice("idotclwnah") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    for term, _, _ in terms:
        for _ in range(60):
            w = list(term)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w) - 1)
                w[i : i + 2] = rng.choice([[w[i + 1], w[i]], [w[i]], [w[i], w[i], w[i + 1]], ["q", w[i + 1]]]) if len(w) > 2 else w[i : i + 2]
            words.append("".join(w) + rng.choice(["", "", "en"]))
    for allowed in ([0] * 7, [1, 1, 0, 0, 1, 1, 2], [2, 1, 1, 1, 2, 0, 3]):
        lexicon = toxicity.Lexicon(terms, allowed, remembered=50, states=states)
        for w, (term, weight) in zip(words, lexicon.match(words), strict=True):
            assert (term, pytest.approx(weight)) == plain_search(terms, allowed, w), (w, allowed)
            assert lexicon.near(w) == plain_near(terms, allowed, w), (w, allowed)
    sent = pickle.loads(pickle.dumps(toxicity.Lexicon(terms, [1] * 7, frozenset({"cretin", "downrights", "clown"}))))
    assert sent.match(["cretin", "cretins", "downrights", "clown", "crretin"]) == [(-1, 0.0), (-1, 0.0), (-1, 0.0), (1, 3.0), (-1, 0.0)]
    assert sent.match(["crtéin"]) == [(4, pytest.approx(2.5 * toxicity.MISSPELLED))]
    assert toxicity.Lexicon([]).match(["word"]) == [(-1, 0.0)]


def plain_lexicon(rows):
    """What ``learn_lexicon`` learns from all of (text, y): terms, their edits, ordinary words."""
    tokens, docs, whole, n = Counter(), Counter(), Counter(), Counter()
    for text, y in rows:
        own = Counter()
        n[y] += 1
        for w in toxicity.WORD.findall(text.lower()):
            whole[y] += 1
            own[w, False] += 1
            for k in range(5, min(10, len(w) - 1) + 1):
                own[w[:k], True] += 1
        for key, count in own.items():
            tokens[key, y] += count
            docs[key, y] += 1
    found = []
    for term, stem in {k for k, _ in tokens}:
        t0, t1, d0, d1 = (c[(term, stem), y] for c in (tokens, docs) for y in (0, 1))
        if d1 >= 4:
            error = 2.5 * math.sqrt(1 / d1 + 1 / (d0 + 0.5))
            least = math.log((t1 + 0.5) / whole[1] / ((t0 + 0.5) / whole[0])) - error
            if least >= math.log(5) and math.log((d1 + 0.5) / n[1] / ((d0 + 0.5) / n[0])) - error >= math.log(2):
                found.append((-least * math.sqrt(d1), stem, term, min(4.0, least)))
    terms = []
    for _, stem, term, least in sorted(found):
        if not any(term.startswith(t) or t.startswith(term) for t, _, _ in terms):
            terms.append((term, stem, least))
    most = [(len(t) >= 4) + (len(t) >= 8) for t, _, _ in terms]
    words = {k[0]: c for (k, y), c in docs.items() if y == 0 and not k[1]}
    near = {w: plain_near(terms, most, w) for w in words}
    near = {w: x for w, x in near.items() if x and 0 not in x.values()}
    allowed = []
    for i, k in enumerate(most):
        heard = [sum(words[w] for w, x in near.items() if words[w] == 1 and x.get(i, 9) <= d) for d in range(1, k + 1)]
        allowed.append(sum(x <= 0.002 * n[0] for x in heard))
    return terms, allowed, {w for w, x in near.items() if words[w] > 1 and any(d <= allowed[i] for i, d in x.items())}


def test_toxicity_query_equals_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    of = lambda folds: [(t, toxic[i]) for i, t in rows if t is not None and i in toxic and fold(i) in folds]
    terms, allowed, ordinary = plain_lexicon(of((1, 2)))
    assert terms

    def features(text):
        low = (text or "").lower()
        hits = [(plain_found(m.group()), low[max(0, m.start() - 64) : m.start()], low[m.end() : m.end() + 48]) for m in toxicity.WORD.finditer(low)]
        n = len(hits)
        hits = [(t, v * toxicity.context_factor(x, y)) for (t, v), x, y in hits if t >= 0]
        stems = sum(v for t, v in hits if terms[t][1])
        words = sum(v for _, v in hits) - stems
        return [math.log1p(words), math.log1p(100 * words / (n + 30)), math.log1p(100 * stems / (n + 30)), math.log1p(stems), math.log1p(len({t for t, _ in hits}))]

    remembered = {}

    def plain_found(word):
        if word not in remembered:
            remembered[word] = plain_search(terms, [0] * len(terms) if word in ordinary else allowed, word)
        return remembered[word]

    train = of((3, 4))
    x, y = np.array([features(t) for t, _ in train]), np.array([v for _, v in train], float)
    model = toxicity.Logistic(x, y)
    want = dict(zip([i for i, _ in rows], model.predict(np.array([features(t) for _, t in rows])), strict=True))
    for r in toxicity.op3_toxicity(spark, docs, labels).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6)


def test_toxicity_of_misspelled_terms_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    lexicon = model.lexicon
    plain = toxicity.ToxicityModel(toxicity.Lexicon(lexicon.terms))
    plain.logistic = model.logistic
    held = docs.join(labels, "doc_id").filter((calibrate.fold(F.col("doc_id")) == 0) & F.col("text").isNotNull()).select("text", "toxic").filter("toxic is not null").collect()
    y = np.array([r["toxic"] == 1 for r in held])
    right = ((model.score([r["text"] for r in held]) >= 0.5) == y).mean()
    assert right >= 0.985
    words = [i for i, (_, stem, _) in enumerate(lexicon.terms) if not stem]
    no_stems = toxicity.ToxicityModel(toxicity.Lexicon([lexicon.terms[i] for i in words], [lexicon.edits[i] for i in words]))
    no_stems.logistic = model.logistic
    assert ((no_stems.score([r["text"] for r in held]) >= 0.5) == y).mean() < right - 0.02  # stems earn their place

    terms = {lexicon.terms[i][0] for i in words}
    rng = random.Random(7)

    def spell(word, kind):
        i = rng.choice([i for i in range(len(word) - 1) if word[i] != word[i + 1]])
        return {
            "swapped": word[:i] + word[i + 1] + word[i] + word[i + 2 :],
            "doubled": word[:i] + word[i] + word[i:],
            "dropped": word[:i] + word[i + 1 :],
            "changed": word[:i] + "1" + word[i + 1 :],
            "doubled and changed": word[:i] + word[i] + word[i] + "1" + word[i + 2 :],
        }[kind]

    texts = [r["text"] for r in held if r["toxic"] == 1 and terms & set(toxicity.WORD.findall(r["text"].lower()))]
    assert len(texts) > 30
    for kind in ("swapped", "doubled", "dropped", "changed"):
        wrong = [toxicity.WORD.sub(lambda m: spell(m.group(), kind) if m.group().lower() in terms else m.group(), t) for t in texts]  # noqa: B023
        assert (model.score(wrong) >= 0.5).mean() >= 0.95, kind
        assert (plain.score(wrong) >= 0.5).mean() < 0.1, kind
    long = [i for i in words if lexicon.edits[i] >= 2]
    assert long
    for i in long * 20:  # the others allow one edit only, so that two in one word are found in longer terms alone
        wrong = spell(lexicon.terms[i][0], "doubled and changed")
        assert lexicon.match([wrong])[0][0] == i, wrong


def test_quality_query_equals_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    good = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    of = lambda folds: [(t, good[i]) for i, t in rows if t is not None and i in good and fold(i) in folds]
    assert hashes and len(of((1, 2))) < 1200
    dictionaries = []
    for y in (1, 0):
        found = []
        for text, label in of((1, 2)):
            raw = text.encode()
            own = sorted({raw[k : k + 4096] for k in range(0, len(raw), 4096)}, key=lambda p: hashlib.blake2b(p, digest_size=8).digest())
            found += [(turn, piece) for turn, piece in enumerate(own) if label == y]
        order = spark.createDataFrame([(t, bytearray(p)) for t, p in found], "turn int, piece binary").orderBy("turn", F.xxhash64("piece"), "piece").limit(2400).collect()
        dictionaries.append(quality.dictionary([bytes(r["piece"]) for r in order], 65_536))
    compressors = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) for d in dictionaries] + [zstandard.ZstdCompressor(level=3)]

    def features(text):
        raw = (text or "").encode()
        a, b, c = (len(z.compress(raw)) for z in compressors)
        n = len(raw) + 20
        return [(b - a) / n, (b - a) / (b + a), math.log(c / n), math.log(n), math.log(c / n) * math.log(n)]

    train = of((3, 4))
    model = quality.Logistic(np.array([features(t) for t, _ in train]), np.array([v for _, v in train], float))
    want = dict(zip([i for i, _ in rows], model.predict(np.array([features(t) for _, t in rows])), strict=True))
    for r in quality.op5_quality(spark, docs, labels).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=0.02)


@pytest.mark.parametrize("op", [quality.op5_quality, toxicity.op3_toxicity])
def test_classifier_learns_from_long_texts(spark, op):
    rng = random.Random(2)
    good, bad = ([" ".join(rng.choice(words) for _ in range(4000)) for _ in range(40)] for words in (["river", "stone", "meadow", "quiet"], ["cheap", "pills", "idiots", "scummy"]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40), int(i >= 40)) for i in range(80)], LABELS)
    assert min(len(t) for t in good + bad) > 16_384
    got = op(spark, docs, labels).collect()
    label = (lambda i: i < 40) if op is quality.op5_quality else (lambda i: i >= 40)
    assert all((r["score"] >= 0.5) == label(r["doc_id"]) for r in got)


def test_sample_of_repeated_identifiers_is_bounded(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], LABELS)
    sample = calibrate.labelled_sample(docs, labels, "quality", [0, 1, 2, 3, 4], 5)
    x, y = calibrate.measured(sample, 1, lambda texts: np.ones((len(texts), 1)), 5)
    assert x.shape == (10, 1) and sorted(y) == [0] * 5 + [1] * 5
    assert sum(map(len, quality.pieces(sample, 4, 3).values())) == 6


def test_quotation_counts_less_than_abuse():
    assert toxicity.context_factor('he said "you ', '" to them') < toxicity.context_factor("well ", " there") < toxicity.context_factor("you ", " there")


# Decontamination


def brute_hits(docs, items, n=13):
    def words(t):
        return decontaminate.WORD.findall((t or "").encode().lower())

    grams = {}
    for i, t in items:
        w = words(t)
        for s in range(len(w) - min(n, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[s : s + min(n, len(w))]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for s in range(len(w) - size + 1):
                g = tuple(w[s : s + size])
                if g in grams:
                    hit.update(range(s, s + size))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(8)
    items = [(k, " ".join(f"Q{rng.randrange(300)}" for _ in range(n))) for k, n in enumerate([30, 13, 14, 5, 1, 0, 30])] + [(7, None), (8, "élan vital"), (1, "second row of item one")]
    docs = [(100, None), (101, ""), (102, "?!"), (103, "ÉLAN, élan-VITAL"), (103, "ÉLAN, élan-VITAL")]
    for k in range(40):
        _, text = rng.choice(items[:4])
        w = text.upper().split()
        a = rng.randrange(max(1, len(w) - 12))
        docs.append((k, " ".join(f"d{rng.randrange(99)}" for _ in range(rng.randrange(60))) + ", " + "; ".join(w[a : a + rng.randrange(10, 20)])))
    return docs, items


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_hits_equal_brute_force_by_broadcast_and_by_join(spark, limit):
    docs, items = planted()
    found = decontaminate.find_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast_bytes=limit)
    got = [
        (r["row"]["doc_id"], r["hits"]["n_words"], len(r["hits"]["hits"]), len(r["hits"]["items"]), sha(",".join(r["hits"]["items"])), r["c"])
        for r in found.withColumn("c", decontaminate.contaminated()).collect()
    ]
    assert sorted(got, key=repr) == brute_hits(docs, items)


def test_spans_are_cut_and_columns_stay(spark):
    docs = spark.createDataFrame([(1, "Keep this. ALPHA, beta gamma! And this.", "h"), (2, None, "h")], "doc_id long, text string, hits string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["hits"]) for r in decontaminate.remove_spans(docs, items).collect()}
    assert got == {1: ("Keep this. ,  ! And this.", "h"), 2: (None, "h")}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.op7_decontaminate(spark, docs, empty).collect())
    assert decontaminate.op7_decontaminate(spark, docs.limit(0), items).count() == 0


@pytest.mark.parametrize("vocabulary", [50, 10**6])
def test_bound_of_the_window_set_holds(spark, vocabulary):
    rng = random.Random(5)
    items = [(str(i), " ".join(f"word{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 5, 30, 400])))) for i in range(600)]
    bound = decontaminate.set_bytes(spark.createDataFrame(items, "item_id string, text string"))
    tracemalloc.start()
    found = decontaminate.GramSet(items, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(found)) < peak <= bound


def test_decontaminate_long_texts_and_shared_windows(spark):
    passage = [f"p{i}" for i in range(30)]
    items = [(1, " ".join(passage)), (2, " ".join(passage[5:25])), (3, "short one"), (3, "short one"), (None, "null item"), (4, None)]
    docs = [(1, "x " * 300_000 + " ".join(passage)), (2, "a short one b null item"), (2, "a short one b null item"), (None, None), (5, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("key", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 27, 0):
        got = [(r["row"]["doc_id"], len(r["hits"]["hits"]), r["hits"]["items"]) for r in decontaminate.find_hits(a, b, max_broadcast_bytes=limit).collect()]
        assert sorted(map(str, got)) == sorted(map(str, [(1, 30, ["1", "2"]), (2, 4, ["3", "null"]), (2, 4, ["3", "null"]), (None, 0, []), (5, 0, [])]))



# BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    ours, theirs = bpe.Encoder(path, cache_words=50), Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = list("aé ü\n\t  \r'srt1½²三Ⅷ🙂 　\x1c\x85\x0b\x00_-.,!?ßḈ​")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|> x", "  ", "   x  y   ", "x" * 20_000, "ab" * 9_000, " " * 3000, "", None]
    for text, (joined, raw) in zip(texts, ours.encode_batch(texts), strict=True):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert joined.decode() == ",".join(map(str, ids))
        assert raw.decode("utf-8", "replace") == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_refuses_files_that_it_would_read_wrongly():
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_supported(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"byte_fallback": True}}, {"added_tokens": [{"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.check_supported(spec | change)


def test_bpe_caches_stay_bounded():
    ours = bpe.Encoder(bpe.vocabulary_path(), cache_bytes=2000)
    for k in range(30):
        ours.encode_batch([f"{k}word" * 200])
    assert sum(map(len, ours.cache)) + sum(map(len, ours.previous)) < 8000


def test_bpe_rows_and_round_trip(spark):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (1, "Hello wörld"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bpe", F.lit(0))
    got = bpe.op9_bpe(spark, df).collect()
    assert len(got) == 5
    for r, (_, t) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_tokens"])), sorted(rows, key=lambda r: r[0] or 0), strict=True):
        assert r["decoded_sha256"] == sha(t or "")
    path = bpe.vocabulary_path()
    back = df.select("text", bpe.decode_udf(path)(bpe.encode_udf(path)(F.col("text"))).alias("again")).collect()
    assert all((r["text"] or "") == r["again"] for r in back)
    assert bpe.op9_bpe(spark, df.limit(0)).count() == 0


# WARC


def test_warc_odd_rows(spark):
    big = "<p>" + "é" * 200 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: y", None), (4, "http://d", ""), (5, "http://e", "x" * 99), (6, "http://f", "x" * 99), (7, "g", "x" * 100), (8, "g", "x" * 100), (8, "g", "x" * 100), (7, "g", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(tuple(r) for r in warc.op4_warc(spark, pages).fillna(-1).collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(j for j, _, k in rows if (k or "") == (h or ""))
        again = len(raw) >= 100 and i > first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else -1))
    assert got == sorted(want)
    assert warc.op4_warc(spark, pages.limit(0)).count() == 0


def test_warc_files_are_valid_records(spark):
    from cairn.session import shared_dir

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    path = shared_dir(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=20_000)
    found = warc.read_archives(spark, path)
    assert found.count() == pages.count()
    joined = found.filter("warc_type = 'response'").join(pages, "page_id").filter(F.col("payload") != F.col("html").cast("binary"))
    assert joined.count() == 0


def test_warc_files_are_bounded_however_lengths_are_mixed(spark):
    """Two hundred long pages among thousands of short ones, in one partition: no file has more than one of them, and none is large."""
    from cairn.session import shared_dir

    pages = spark.createDataFrame([(i, "u", "p" * 400_000 + str(i) if i % 20 == 0 else f"short {i}") for i in range(4000)], "page_id long, url string, html string").coalesce(1)
    path = shared_dir(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=200_000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    sizes = [[int(h["Content-Length"]) for h, _ in warc.parse_records(gzip.decompress(bytes(f["content"])))] for f in files]
    assert sum(map(len, sizes)) == 4000
    assert all(len(s) == 1 for s in sizes if max(s) > 1000) and max(map(sum, sizes)) < 16 * 200_000 and max(map(len, sizes)) > 100
    assert warc.read_archives(spark, path).filter("octet_length(payload) = declared_bytes").count() == 4000


def test_warc_long_pages_fresh_dates_and_shared_page_ids(spark):
    from cairn.session import shared_dir

    long = "<p>" + "é word " * 500_000
    rows = [(1, "u", long), (2, None, long), (3, None, None), (3, "u", "y" * 150), (4, "u", "y" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).withColumn("bytes", F.lit(1))
    path = shared_dir(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=1000)
    heads = [h for content in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect() for h, _ in warc.parse_records(gzip.decompress(bytes(content["content"])))]
    assert all(h["WARC-Date"] >= "2024" for h in heads)
    # Different payloads of one page have records of their own.
    assert len({h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}) == 3
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.op4_warc(spark, pages).collect())
    n = len(long.encode())
    assert got == [(1, n, "response", 0), (2, n, "revisit", 1), (3, 0, "response", 0), (3, 150, "response", 0), (4, 150, "revisit", 3)]


# Pipeline


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark, rows):
    """Documents with columns that clash with those the stages work with."""
    df = spark.createDataFrame([(i, t, la, "s", 0) for i, t, la in rows], ODD_DOCS)
    for name in ("row", "doc", "node", "lid", "hits", "kept", "digest", "whole", "class_id", "bpe", "out"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}x" for _ in range(n))
    a, b, long = some(40), some(40), some(150_000)
    near = a.rsplit(" ", 2)[0] + " other end"
    rows = [(1, None, "en"), (2, "", None), (3, "12 ..", "fr"), (4, a, "en"), (4, a, "en"), (None, a, "en"), (5, near, "en"), (5, b, "fr"), (None, b.upper(), None), (6, long, None), (7, "zwei wörter", "de"), (7, "zwei wörter", "de")]
    docs = odd_documents(spark, rows)
    stage = dict(pipeline.STAGES)
    keep = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = lambda found: sorted(found, key=str)
    languages = stage["language_id"](spark, docs, SMALL)
    assert languages.columns == docs.columns
    assert keep(languages) == want((i, t) for i, t, _ in rows if i not in (1, 2, 3))
    exact = stage["exact_dedup"](spark, docs, SMALL)
    assert exact.columns == docs.columns
    assert [i for i, t in keep(exact) if not t] == [2]
    assert want((i, t) for i, t in keep(exact) if t) == want([(3, "12 .."), (4, a), (5, near), (5, b), (6, long), (7, "zwei wörter")])
    near_ones = stage["near_dedup"](spark, docs, SMALL)
    assert near_ones.columns == docs.columns
    # b and B are one text; of a and its near copies the row without an identifier stays.
    assert keep(near_ones) == want([(1, None), (2, ""), (3, "12 .."), (None, a), (None, b.upper()), (6, long), (7, "zwei wörter"), (7, "zwei wörter")])
    clean = stage["decontaminate"](spark, docs, SMALL)
    assert clean.columns == docs.columns
    assert keep(clean) == want((i, t) for i, t, _ in rows)
    assert stage["bpe"](spark, docs, SMALL).count() == len(rows)
    for name, run in pipeline.STAGES:
        assert run(spark, docs.limit(0), SMALL).count() == 0, name


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from tests.llm.test_dedup import brute_classes, lower

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    last = {}
    for i, t in rows:
        last[lower(t)] = max(i, last.get(lower(t), i))
    rows = [(i, t) for i, t in rows if last[lower(t)] == i]
    classes = brute_classes(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    clean = {h[0] for h in brute_hits(rows, items) if not h[5]}
    got = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in got.collect()} == clean
    texts = dict(rows)
    assert all(r["decoded_sha256"] == sha(texts[r["doc_id"]]) for r in got.collect())
