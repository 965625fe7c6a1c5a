"""Toxicity scores from a lexicon matched by Levenshtein automata.

The lexicon is learned: words, and word beginnings (stems), that are much more frequent in texts
labelled toxic than in others, each with its log ratio as weight. It is held as a trie of
characters. Its intersection with the Levenshtein automaton of distance k is an automaton that reads
a word: a state is the trie's nodes that the word so far can have led to, each with its least number
of edits (a character wrong, missing, too many, or swapped with the next one). States are made when
a word first leads to them and remembered, so that further words cost a look-up a character.

How many edits a term allows is learned as well, up to ``LENGTHS``: the most at which the words near it
(for stems, the words that begin with something near it) are found in hardly any text of the
sample that is not toxic. Words that several such texts have are ordinary ones and no misspellings.

Each hit gets a context score from the window around it: quotation marks on both sides or a
reporting word count towards quotation, second-person words towards abuse. The sums of the
weighted hits, by document and by words, are calibrated by a logistic regression.

The training sample is bounded: at most ``max_rows`` labelled rows a class, of any length, for the
lexicon and for calibration each.

Cases: null and empty texts are scored alike, as a text without hits; without labels of both
classes every score is the share of label 1 (0.5 without any); texts of any length are scanned
whole; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.calibrate import Logistic, class_totals, class_weights, fold, labelled_sample, measured
from cairn.session import arrow_batches, materialise

FEATURES = 5
#: Lengths from which a term may allow one edit, two and so on, and what each edit leaves of its weight.
LENGTHS, MISSPELLED = (4, 8), 0.7
WORD = re.compile(r"[^\W_]+")
#: Words that report speech and words that address someone, and quotation marks.
REPORTING = "said says say wrote writes called calls quoted quote quotes term word slur dit écrit mot sagte schrieb wort dijo escribió palabra"
ADDRESSING = "you your you're ur yourself tu toi vous du dich dein sie eres tú usted"
OPENING, CLOSING = '"“«„‘', '"”»“’'
CUE = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
BEFORE, AFTER = 64, 48


NO_HIT = (-1, 0.0)


class State:
    """A state of the automaton: what can follow, and the terms (place, edits) found by whole words and by beginnings."""

    __slots__ = ("begins", "best_begin", "best_end", "ends", "following", "nodes")

    def __init__(self, nodes: tuple[tuple[int, int, str], ...]):
        self.nodes, self.following = nodes, {}
        self.ends: list[tuple[int, int]] = []
        self.begins: list[tuple[int, int]] = []
        self.best_end = self.best_begin = NO_HIT


class Lexicon:
    """Terms (text, is_stem, weight) in a trie, run through by the Levenshtein automaton of distance k.

    ``edits`` has k for each term. A stem matches every word that begins with something within its
    edits, other terms match whole words. Each edit leaves ``MISSPELLED`` of a term's weight.
    ``ordinary`` words are no misspellings of anything. ``remembered`` bounds the words and ``states`` the
    states that are kept; they are found again when forgotten.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], edits: list[int] | None = None, ordinary: frozenset[str] = frozenset(), remembered: int = 200_000, states: int = 50_000):
        self.terms, self.remembered, self.max_states = terms, remembered, states
        self.edits = [0] * len(terms) if edits is None else edits
        #: By node of the trie: its children, the terms that end there, the most edits of a term there or below.
        self.children: list[dict[str, int]] = [{}]
        self.at: list[list[int]] = [[]]
        self.slack: list[int] = [max(self.edits, default=-1)]
        for i, (term, _, _) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.at.append([])
                    self.slack.append(-1)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], self.edits[i])
            self.at[node].append(i)
        #: Characters of a word that can matter, and one more.
        self.reach = max((len(t) + k for (t, _, _), k in zip(terms, self.edits, strict=True)), default=0) + 1
        self._forget()
        exact = Lexicon(terms) if ordinary else self
        self.known = {w: exact.search(w) for w in ordinary}
        self.found: dict[str, tuple[int, float]] = dict(self.known)

    def _forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state({(0, ""): 0})

    def __getstate__(self):
        return self.__dict__ | {"found": dict(self.known), "states": {}, "start": None}

    def __setstate__(self, fields):
        self.__dict__.update(fields)
        self._forget()

    def _state(self, least: dict[tuple[int, str], int]) -> State:
        """The state of (node, character that must come before it counts) with least edits, and of what missing characters add."""
        open_ = list(least)
        while open_:
            node, due = open_.pop()
            spent = least[node, due] + 1
            if not due:
                for child in self.children[node].values():
                    if spent <= self.slack[child] and spent < least.get((child, ""), spent + 1):
                        least[child, ""] = spent
                        open_.append((child, ""))
        key = tuple(sorted((node, spent, due) for (node, due), spent in least.items()))
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(key)
            for node, spent, due in key:
                for i in () if due else self.at[node]:
                    if spent <= self.edits[i]:
                        (state.begins if self.terms[i][1] else state.ends).append((i, spent))
            state.best_begin, state.best_end = self._best(state.begins), self._best(state.ends)
        return state

    def _best(self, hits: list[tuple[int, int]]) -> tuple[int, float]:
        """The term that weighs most, the first of equals."""
        return min(((i, self.terms[i][2] * MISSPELLED**d) for i, d in hits), key=lambda x: (-x[1], x[0]), default=NO_HIT)

    def _step(self, state: State, c: str) -> State:
        """The state after the character ``c``."""
        least: dict[tuple[int, str], int] = {}

        def reach(node: int, spent: int, due: str = "") -> None:
            if spent <= self.slack[node] and spent < least.get((node, due), spent + 1):
                least[node, due] = spent

        for node, spent, due in state.nodes:
            if due:
                if due == c:
                    reach(node, spent)
                continue
            reach(node, spent + 1)  # one too many
            for x, child in self.children[node].items():
                reach(child, spent + (x != c))
                if x != c and c in self.children[child]:  # swapped: x is due next
                    reach(self.children[child][c], spent + 1, x)
        return self._state(least)

    def run(self, word: str):
        """The states that the word leads to, as far as any term can still match."""
        if len(self.states) > self.max_states:
            self._forget()
        state = self.start
        yield state
        for c in word:
            following = state.following.get(c)
            if following is None:
                following = state.following[c] = self._step(state, c)
            state = following
            yield state
            if not state.nodes:
                return

    def near(self, word: str) -> dict[int, int]:
        """All terms within their edits of the word, or of its beginning, with the least edits."""
        least: dict[int, int] = {}
        for state in self.run(word):
            for i, d in state.begins:
                least[i] = min(d, least.get(i, d))
        return least | dict(state.ends)

    def search(self, word: str) -> tuple[int, float]:
        """The term that weighs most in the word, and its weight; (-1, 0.0) without any."""
        best, weight = NO_HIT
        for state in self.run(word):
            i, w = state.best_begin
            if i >= 0 and (w > weight or w == weight and i < best):
                best, weight = i, w
        i, w = state.best_end
        return (i, w) if i >= 0 and (w > weight or w == weight and i < best) else (best, weight)

    def match(self, words: list[str]) -> list[tuple[int, float]]:
        """:meth:`search` of each word, ordinary ones without edits; what was found lately is remembered."""
        found = self.found
        out = list(map(found.get, words))
        k = -1
        for _ in range(out.count(None)):
            k = out.index(None, k + 1)
            word = words[k] if len(words[k]) < self.reach else words[k][: self.reach] + "+"  # no word has a plus
            hit = found.get(word)
            if hit is None:
                if len(found) >= self.remembered:
                    found.clear()
                    found.update(self.known)
                hit = found[word] = self.search(word)
            out[k] = hit
        return out


REPORTS, ADDRESSES = frozenset(REPORTING.split()), frozenset(ADDRESSING.split())


def context_factor(before: str, after: str) -> float:
    """From 0.2, quotation, to 1.3, abuse."""
    quoted = any(q in before for q in OPENING) and any(q in after for q in CLOSING)
    near = {w.lower() for w in CUE.findall(before)[-6:] + CUE.findall(after)[:6]}
    factor = 1.0
    if quoted:
        factor *= 0.5
    if near & REPORTS:
        factor *= 0.4 if quoted else 0.7
    if near & ADDRESSES:
        factor *= 1.3
    return factor


class ToxicityModel:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.logistic = lexicon, None

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, float]]]]:
        """For each text its number of words and its hits (term, weight with context)."""
        out = []
        for text in texts:
            low = "" if text is None else text.lower()
            words = WORD.findall(low)
            found = self.lexicon.match(words)
            hits = []
            if found.count(NO_HIT) < len(found):
                for (term, weight), m in zip(found, WORD.finditer(low), strict=True):
                    if term >= 0:
                        hits.append((term, weight * context_factor(low[max(0, m.start() - BEFORE) : m.start()], low[m.end() : m.end() + AFTER])))
            out.append((len(words), hits))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for i, (n, hits) in enumerate(self.hits(texts)):
            total = sum(v for _, v in hits)
            stems = sum(v for t, v in hits if self.lexicon.terms[t][1])
            words = total - stems
            out[i] = math.log1p(words), math.log1p(100 * words / (n + 30)), math.log1p(100 * stems / (n + 30)), math.log1p(stems), math.log1p(len({t for t, _ in hits}))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.logistic.predict(self.features(texts)) if texts else np.zeros(0)


def word_counts(sample: DataFrame, lengths: tuple[int, int] = (5, 10), held: int = 300_000) -> DataFrame:
    """(term, stem, tokens0, docs0, tokens1, docs1) of words and of word beginnings in (text, y)."""

    def count(batches):
        tokens: Counter = Counter()
        docs: Counter = Counter()

        def flush():
            keys = list(tokens)
            out = pa.record_batch(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([tokens[k] for k in keys], pa.int64()), pa.array([docs[k] for k in keys], pa.int64())],
                names=["term", "stem", "y", "tokens", "docs"],
            )
            tokens.clear()
            docs.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter = Counter()
                for w, n in Counter(WORD.findall(text.lower())).items():
                    own[w, False, y] += n
                    for k in range(lengths[0], min(lengths[1], len(w) - 1) + 1):
                        own[w[:k], True, y] += n
                    own["", False, y] += n
                tokens.update(own)
                docs.update(own.keys())
                if len(tokens) > held:
                    yield flush()
        yield flush()

    counted = sample.select("text", "y").mapInArrow(count, "term string, stem boolean, y int, tokens long, docs long")
    return counted.groupBy("term", "stem").agg(
        *[F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for y in (0, 1) for c in ("tokens", "docs")]
    )


def learn_terms(counts: DataFrame, whole: dict[str, int], min_docs: int = 4, min_ratio: float = 5.0, min_doc_ratio: float = 2.0, errors: float = 2.5) -> list[tuple[str, bool, float]]:
    """All terms that are typical of label 1, none of them the beginning of another.

    A term's ratio is that of its shares of all words under label 1 and 0; what counts, and is its
    weight, is the lower bound of its logarithm, ``errors`` standard errors below. The errors
    come from the numbers of documents, as a term's repetitions in one document go together.
    The ratio of its shares of documents must be above ``min_doc_ratio`` by the same errors.
    Of terms that begin with each other the one with more evidence stays.
    """
    if not whole["tokens0"] or not whole["tokens1"]:
        return []

    def ratio(c: str):
        return F.log(((F.col(f"{c}1") + 0.5) / whole[f"{c}1"]) / ((F.col(f"{c}0") + 0.5) / whole[f"{c}0"]))

    error = errors * F.sqrt(1 / F.col("docs1") + 1 / (F.col("docs0") + 0.5))
    ranked = counts.filter("term <> ''").filter(F.col("docs1") >= min_docs).withColumn("least", ratio("tokens") - error)
    ranked = ranked.filter(F.col("least") >= math.log(min_ratio)).filter(ratio("docs") - error >= math.log(min_doc_ratio)).withColumn("evidence", F.col("least") * F.sqrt("docs1"))
    terms: list[tuple[str, bool, float]] = []
    beginnings: set[str] = set()
    for r in ranked.orderBy(F.desc("evidence"), "stem", "term").collect():  # significant words of a bounded sample
        term = r["term"]
        own = {term[:k] for k in range(1, len(term) + 1)}
        if term not in beginnings and not any(t in own for t in (x[0] for x in terms)):
            terms.append((term, r["stem"], min(4.0, float(r["least"]))))
            beginnings |= own
    return terms


def learn_lexicon(sample: DataFrame, lengths: tuple[int, ...] = LENGTHS, ordinary_docs: int = 2, max_noise: float = 0.002) -> Lexicon:
    """The terms that are typical of label 1, each with the edits that it allows.

    Words near a term that at least ``ordinary_docs`` documents of label 0 have are ordinary. A term
    allows the most edits, up to one for each of ``lengths`` that it reaches, at which other words of label 0
    near it are found in at most the share ``max_noise`` of the documents, counted word by word.
    """
    counts = materialise(word_counts(sample), "terms")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens0", "docs0", "tokens1", "docs1")]
    whole = counts.filter("term = ''").agg(*sums).first().asDict()
    terms = learn_terms(counts, whole)
    if not terms:
        return Lexicon([])
    probe = Lexicon(terms, [sum(len(t) >= n for n in lengths) for t, _, _ in terms])
    sent = counts.sparkSession.sparkContext.broadcast(probe)

    def near(batches):
        for batch in batches:
            out: list[tuple] = []
            for word, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sent.value.near(word)
                if 0 not in found.values():
                    out += [(word, docs, i, d) for i, d in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("word", "docs", "i", "d"), x, strict=True)) for x in out], pa.schema([("word", pa.string()), ("docs", pa.int64()), ("i", pa.int32()), ("d", pa.int32())]))

    words = counts.filter("term <> '' and not stem and docs0 > 0").select("term", "docs0")
    close = materialise(words.mapInArrow(near, "word string, docs long, i int, d int"), "near")
    noise = {(r["i"], r["d"]): r["n"] for r in close.filter(F.col("docs") < ordinary_docs).groupBy("i", "d").agg(F.sum("docs").alias("n")).collect()}  # rows a term and edit
    edits = []
    for i, most in enumerate(probe.edits):
        heard = np.cumsum([noise.get((i, d), 0) for d in range(1, most + 1)])
        edits.append(int((heard <= max_noise * whole["docs0"]).sum()))
    allowed = F.get(F.array(*[F.lit(k) for k in edits]), F.col("i"))
    plain = close.filter(F.col("docs") >= ordinary_docs).filter(F.col("d") <= allowed).select("word").distinct()
    return Lexicon(terms, edits, frozenset(r["word"] for r in plain.collect()))  # words of a bounded sample near its terms


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> ToxicityModel:
    """Learn the lexicon on folds 1 and 2, calibrate on folds 3 and 4."""
    model = ToxicityModel(learn_lexicon(labelled_sample(docs, labels, "toxic", [1, 2], max_rows)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    x, y = measured(labelled_sample(docs, labels, "toxic", [3, 4], max_rows), FEATURES, lambda texts: sent.value.features(texts), max_rows)
    model.logistic = Logistic(x, y, class_weights(y, class_totals(labels, "toxic", [3, 4])))
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Each row as struct ``row`` with ``score``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def apply(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(text.to_pylist()))

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.withColumn("score", apply(F.col("row.text")))


def op3_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the contract; 0.5 is its threshold."""
    arrow_batches(spark)
    found = score(docs, train(docs, labels))
    doc = F.col("row.doc_id")
    return found.select(doc.alias("doc_id"), (fold(doc) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
