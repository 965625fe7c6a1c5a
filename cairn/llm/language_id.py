"""Language identification by prediction by partial matching (PPM).

Training counts byte 4-grams by language over all training documents; they are the nodes of one
context tree a language, of orders 0 to 3. Escapes follow method C with exclusion: a context seen
n times before d distinct bytes gives a byte seen c times the probability c / (n + d) and escapes
with d / (n + d) to the next shorter one; below order 0 all bytes are alike. Statistics are
frozen after training, so the code length of each known 4-gram is worked out once for every
language, and each context keeps what its escape costs; scoring a text is a look-up a byte, and
another one an order for bytes that no language has seen in their context. The language whose
tree needs the fewest bits wins, and the score is its posterior probability.

Bytes are folded first: A-Z lower-cased, digits, other ASCII printables, and white space with controls are
one symbol each; all other bytes stay as they are. Every language, every training row and every node
counts. Where the trees would have more than ``max_cells`` cells (nodes times languages), they are cut
into zones of contexts by the two bytes before the last one; texts pass one zone after another and
sum up what it says of the bytes whose contexts it holds, with the same result. A zone has at most
``max_cells`` cells, or the nodes of one such pair (157 and 157^2 at most) and the short contexts (as
many), so the driver and a task never hold more than that.

Cases: a text that is null or has no letter (Unicode categories L*) is ``und`` with score 0;
without training rows every text is ``und``; ties go to the first language in alphabetical order;
texts of any length are scored whole in blocks; repeated rows each get their row; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import arrow_batches, materialise

ORDER, BLOCK = 3, 1 << 18
LETTER = regex.compile(r"\p{L}")


def fold_table() -> np.ndarray:
    """The folded byte of each byte."""
    out = np.arange(256, dtype=np.uint8)
    out[:33] = out[127] = 32
    out[33:127] = ord(".")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return out


FOLD = fold_table()
SYMBOLS = len(np.unique(FOLD))


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of the texts, each after ORDER spaces, and where each one's own bytes start."""
    raw = [t.encode("utf-8") for t in texts]
    pad = b" " * ORDER
    whole = np.frombuffer(pad + pad.join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return FOLD[whole], np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]]) + ORDER


def grams_of(raw: np.ndarray) -> np.ndarray:
    """Each four bytes in a row as a number."""
    b = raw.astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


def own_grams(texts: list[str]) -> np.ndarray:
    """The 4-grams that end in the texts' own bytes."""
    raw, starts = joined_bytes(texts)
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.append(starts[1:] - ORDER, len(raw)), -1)
    return grams_of(raw)[np.cumsum(change)[ORDER:-1] > 0]


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True for the rows that training never sees."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def count_grams(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text): 4-grams of folded bytes as a number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in waiting.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            waiting.clear()

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                own = own_grams(texts)
                waiting.setdefault(lang, []).append(own)
                size += len(own)
            if size > 16 * BLOCK:
                yield from flush()
                size = 0
        yield from flush()

    return train.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Slots:
    """Rows of distinct 32-bit keys, found for many keys at once by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.none = len(keys)
        self.keys = np.append(keys, 0).astype(np.uint32)
        self.mask = np.int64((1 << max(4, (2 * len(keys)).bit_length())) - 1)
        self.slots = np.full(self.mask + 1, self.none, np.int32)
        rows, at = np.arange(len(keys), dtype=np.int32), self._home(self.keys[:-1])
        while len(rows):
            free = self.slots[at] == self.none
            self.slots[at[free]] = rows[free]
            left = self.slots[at] != rows
            rows, at = rows[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, ``none`` where there is none."""
        at = self._home(keys)
        row = self.slots[at]
        looking = np.flatnonzero((self.keys[row] != keys) & (row != self.none))
        while len(looking):
            at[looking] = (at[looking] + 1) & self.mask
            row[looking] = found = self.slots[at[looking]]
            looking = looking[(self.keys[found] != keys[looking]) & (found != self.none)]
        return row


def weights(total: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 of what the counts of a context are divided by, and the bits to escape from it."""
    known = total > 0
    seen = np.log2(np.where(known, total + distinct, 1))
    return seen.astype(np.float32), (seen - np.log2(np.where(known, distinct, 1))).astype(np.float32)


class Order:
    """The nodes of one order: the grams of ``size`` bytes that some language has, and their contexts."""

    def __init__(self, size: int, langs: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.size = size
        self.grams, at = np.unique(gram, return_inverse=True)
        counts = np.zeros((len(self.grams), langs))
        counts[at, lang] = n
        contexts, self.of = np.unique(self.grams >> 8, return_inverse=True)
        self.counts, self.contexts = counts, contexts
        self.total, self.distinct = self.by_context(counts), self.by_context(counts > 0)
        self.gram, self.context = Slots(self.grams), Slots(contexts)
        #: log2 of the counts; NaN where a language has not seen the gram, as in the row of unknown grams.
        self.bits = np.full((len(counts) + 1, langs), np.nan, np.float32)
        np.log2(counts, out=self.bits[:-1], where=counts > 0, casting="same_kind")
        self.own = [np.concatenate([x, np.zeros((1, langs), np.float32)]) for x in weights(self.total, self.distinct)]

    def by_context(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.contexts), values.shape[1]))
        np.add.at(out, self.of, values)
        return out

    def leave_for(self, low: Order) -> None:
        """What the next shorter context divides by and costs to leave, without the bytes of each context here."""
        mask = (1 << 8 * low.size) - 1
        seen = self.counts > 0
        shorter = low.counts[np.searchsorted(low.grams, self.grams & mask)]
        own = np.searchsorted(low.contexts, self.contexts & mask >> 8)
        self.left = weights(low.total[own] - self.by_context(np.where(seen, shorter, 0)), low.distinct[own] - self.by_context(seen))

    def forget(self) -> None:
        """Drop what only training needs."""
        del self.counts, self.contexts, self.of, self.total, self.distinct


class Trees:
    """Context trees of several languages, compiled to code lengths.

    ``orders`` has (lang, gram, n) as arrays for the grams of 4, 3, 2 and 1 bytes, as numbers. With a
    ``zone``, those of 4 and 3 bytes are the ones whose two bytes before the last are in that range, and only
    bytes after such a pair are charged.
    """

    def __init__(self, langs: list[str], orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]], symbols: int = SYMBOLS, zone: tuple[int, int] | None = None):
        self.langs, self.zone = langs, zone
        self.orders = [Order(ORDER + 1 - o, len(langs), *rows) for o, rows in enumerate(orders)]
        for high, low in zip(self.orders[:-1], self.orders[1:], strict=True):
            high.leave_for(low)
        self.new = np.log2(np.maximum(symbols - self.orders[-1].distinct[:1].sum(axis=0), 1)).astype(np.float32)
        top = self.orders[0]
        grams = top.grams
        for order in self.orders:
            order.forget()
            del order.grams
        compiled = np.zeros_like(top.bits)
        for at in range(0, len(grams), BLOCK):
            compiled[at : at + BLOCK][: len(grams) - at] = self.code_lengths(grams[at : at + BLOCK])
        #: Code lengths of the known 4-grams; ``top.bits`` has counts of languages, not needed any more.
        self.compiled, self.known = compiled, top.gram

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each 4-gram after its first three: a row a gram, a column a language."""
        spent = np.zeros((len(grams), len(self.langs)), np.float32)
        out = np.full_like(spent, np.nan)
        longer = None
        for order in self.orders:
            g = (grams & np.uint32((1 << 8 * order.size) - 1)).astype(np.uint32)
            context = order.context.find(g >> np.uint32(8))
            seen, escape = order.own[0][context], order.own[1][context]
            if longer is not None:
                above, rows = longer
                inside = rows != above.context.none
                seen[inside], escape[inside] = above.left[0][rows[inside]], above.left[1][rows[inside]]
            code = spent + seen - order.bits[order.gram.find(g)]
            out = np.where(np.isnan(out), code, out)
            spent += escape
            longer = order, context
        return np.where(np.isnan(out), spent + self.new, out)

    def total_bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths of whole texts: a row a text, a column a language."""
        raw, starts = joined_bytes(texts)
        total = np.zeros((len(texts), len(self.langs)))
        ends = np.append(starts[1:] - ORDER, len(raw))
        for at in range(0, len(raw) - ORDER, BLOCK):  # positions at + ORDER and on
            grams = grams_of(raw[at : at + BLOCK + ORDER])
            row = self.known.find(grams)
            bits = self.compiled[row]
            unknown = row == self.known.none
            if self.zone is not None:
                pair = grams >> np.uint32(8) & np.uint32(0xFFFF)
                here = (pair >= self.zone[0]) & (pair <= self.zone[1])
                bits[~here] = 0
                unknown &= here
            new = np.flatnonzero(unknown)
            if len(new):
                bits[new] = self.code_lengths(grams[new])
            low, high = at + ORDER, at + ORDER + len(grams)
            first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(starts, high, side="left")
            cuts = np.stack([np.clip(starts[first:last], low, high), np.clip(ends[first:last], low, high)], axis=1) - low
            full = cuts[:, 0] < cuts[:, 1]
            if full.any():
                edges = cuts[full].ravel()
                padded = np.concatenate([bits, np.zeros((1, bits.shape[1]), np.float32)])
                total[first:last][full] += np.add.reduceat(padded, edges, axis=0, dtype=np.float64)[::2]
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its posterior probability."""
        use = [i for i, t in enumerate(texts) if charged(t)]
        bits = np.zeros((len(texts), len(self.langs)))
        if use and self.langs:
            bits[use] = self.total_bits([texts[i] for i in use])
        return decide(self.langs, texts, bits)


def charged(text: str | None) -> bool:
    """Whether a text has a letter."""
    return text is not None and LETTER.search(text) is not None


def decide(langs: list[str], texts: list[str | None], bits: np.ndarray) -> tuple[list[str], list[float]]:
    """The language of fewest bits of each text and its posterior probability."""
    found, scores = ["und"] * len(texts), [0.0] * len(texts)
    if langs and texts:
        best = bits.argmin(axis=1)
        gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
        posterior = 1 / np.exp2(-gap).sum(axis=1)
        for i, text in enumerate(texts):
            if charged(text):
                found[i], scores[i] = langs[best[i]], float(posterior[i])
    return found, scores


class Forest:
    """The counted nodes (k, size, g, n) as a table, and the zones in which trees are made of them."""

    def __init__(self, langs: list[str], nodes: DataFrame, zones: list[tuple[int, int]]):
        self.langs, self.nodes, self.zones = langs, nodes, zones

    def trees(self, zone: tuple[int, int]) -> Trees:
        nodes = self.nodes.filter((F.col("size") < ORDER) | pair_of_context().between(*zone))
        found = nodes.select("k", "size", "g", "n").toPandas()
        parts = [found[found["size"] == size] for size in range(ORDER + 1, 0, -1)]
        orders = [(p["k"].to_numpy(np.int64), p["g"].to_numpy(np.int64), p["n"].to_numpy(np.float64)) for p in parts]
        return Trees(self.langs, orders, zone=zone if len(self.zones) > 1 else None)


def pair_of_context() -> Column:
    """The two bytes before the last one of a gram ``g`` of three or four."""
    return F.shiftrightunsigned("g", 8).bitwiseAND(F.lit(0xFFFF))


def cut_zones(cells: dict[int, int], max_cells: int) -> list[tuple[int, int]]:
    """Ranges of pairs that have at most ``max_cells`` cells each, or are one pair."""
    low, size, zones = 0, 0, []
    for pair, n in sorted(cells.items()):
        if size and size + n > max_cells:
            zones.append((low, pair - 1))
            low, size = pair, 0
        size += n
    return [*zones, (low, 0xFFFF)]


def train(labelled: DataFrame, max_cells: int = 1 << 24) -> Forest:
    """Count the nodes of all orders over all rows of (lang, text)."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and text is not null and text <> ''")
    grams = materialise(count_grams(rows), "grams")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())  # one row a language
    known = F.broadcast(spark.createDataFrame(list(enumerate(langs)), "k int, lang string"))
    sizes = [F.struct(F.lit(size).alias("size"), F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("g")) for size in range(ORDER + 1, 0, -1)]
    nodes = grams.select("lang", "n", F.explode(F.array(*sizes)).alias("x")).groupBy("lang", "x.size", "x.g").agg(F.sum("n").alias("n"))
    nodes = materialise(nodes.join(known, "lang").select("k", "size", "g", "n"), "nodes")
    cells = nodes.filter(F.col("size") >= ORDER).select("size", "g").distinct().groupBy(pair_of_context().alias("pair")).agg(F.count("*").alias("n"))
    return Forest(langs, nodes, cut_zones({r["pair"]: r["n"] * len(langs) for r in cells.collect()}, max_cells))  # at most 157^2 rows


def identify(docs: DataFrame, forest: Forest) -> DataFrame:
    """Each row as struct ``row`` with ``lid``: lang_pred and score."""
    spark = docs.sparkSession
    arrow_batches(spark)
    langs, answer = forest.langs, "struct<lang_pred: string, score: double>"

    def answers(found: tuple[list[str], list[float]]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], names=["lang_pred", "score"])

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    if len(forest.zones) == 1:
        model = spark.sparkContext.broadcast(forest.trees(forest.zones[0]))

        @F.arrow_udf(answer)
        def predict(text: pa.Array) -> pa.Array:
            return answers(model.value.predict(text.to_pylist()))

        return rows.withColumn("lid", predict(F.col("row.text")))

    def charge(sent):
        @F.arrow_udf("array<double>")
        def add(text: pa.Array, spent: pa.Array) -> pa.Array:
            texts = text.to_pylist()
            use = [i for i, t in enumerate(texts) if charged(t)]
            bits = np.array(spent.to_pylist(), float).reshape(len(texts), len(langs))
            if use:
                bits[use] += sent.value.total_bits([texts[i] for i in use])
            return pa.array(list(bits), pa.list_(pa.float64()))

        return add

    @F.arrow_udf(answer)
    def choose(text: pa.Array, spent: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        return answers(decide(langs, texts, np.array(spent.to_pylist(), float).reshape(len(texts), len(langs))))

    rows = rows.withColumn("bits", F.array_repeat(F.lit(0.0), len(langs)))
    for zone in forest.zones:
        sent = spark.sparkContext.broadcast(forest.trees(zone))
        rows = materialise(rows.select("row", charge(sent)(F.col("row.text"), F.col("bits")).alias("bits")), "zone")
        sent.unpersist()
    return rows.select("row", choose(F.col("row.text"), F.col("bits")).alias("lid"))


def fit_and_identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, then predict every row from its text."""
    arrow_batches(docs.sparkSession)
    return identify(docs, train(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")))


def op2_language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    found = fit_and_identify(docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lid.lang_pred", "lid.score")
