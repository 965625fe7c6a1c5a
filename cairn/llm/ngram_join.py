"""Similarity join of documents on sets of word n-grams, with the components of its links.

A document's set has the hashes of its distinct shingles. Rows with equal sets are one text. Of each set the
rarest shingles are its keys: by a fixed order (counts of all shingles in ``BUCKETS`` buckets, then the hash) two
sets of Jaccard similarity t share a shingle among the first (1 - t) of the larger one and the first
(1 - t) / (1 + t) of the smaller one. The counts only decide the order, so what is found doesn't depend on them; they keep
passages that many documents share out of the keys.

The texts of a key stand in tiles: bands of sizes, each within ``t`` of the next, cut into cells of bounded
size. Tiles of the same and of neighbouring bands meet; a key of few texts is a tile of its own. Each text has a bitmap that its shingles are hashed to:
bits that differ are shingles that differ, so their number bounds the overlap from above. Pairs whose bound is
high enough are verified by intersecting the sorted hashes of their whole texts.

There are two rounds. The first compares the texts of a key with the one whose own keys are the most
common, which usually is what the others are edited from. The second compares in tiles all pairs that are not
in one component yet; only these can change a component. Links and components are tables.

Cases: null and wordless texts have the empty set, are linked with nothing and are their own component; a text of
fewer words than a shingle has one shingle, all its words; a null identifier is smaller than every other; rows that
repeat a text are linked, different texts under one identifier or none each stand for themselves; an empty
table gives an empty result; further columns are not needed; texts may be of any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.near_dedup import mix, shared_keys
from cairn.operators.graphs import components
from cairn.session import arrow_batches, materialise

#: Two texts link if 100 * intersection >= PERCENT * union.
PERCENT = 80
SHINGLE = 5
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Counters of shingles, and how many of them a row of counts has.
BUCKETS, SEGMENT = 1 << 20, 4096
#: Texts of a key and band that a cell holds, pairs that are compared at once, and texts of a key that need no tiles.
CELL, CHUNK, FEW = 2048, 100_000, 32
#: Bits of a bitmap, least and most; between them about four a shingle.
BITS = (64, 65536)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    known: dict[bytes, int] = {}
    hashes: list[int] = []
    first = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = b"".split() if text is None else text.encode("utf-8").lower().split()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        first[i + 1] = len(hashes)
    words = np.array(hashes, np.uint64)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    ends = np.cumsum(count)
    doc = np.repeat(np.arange(len(texts)), count)
    at = first[doc] + np.arange(len(doc)) - (ends - count)[doc]
    length = np.minimum(n, size)[doc]
    found = mix(length.astype(np.uint64))
    for j in range(size):
        has = length > j
        found[has] = mix(found[has] * MULT + words[at[has] + j])
    return [np.unique(found[a:b]) for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True)]


def keys_of(s: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, float]:
    """The rarest shingles of a set, how many of them count where it is the smaller one, and how common they are."""
    n = len(s)
    common = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.lexsort((s, common))[: n - -(-percent * n // 100) + 1]
    return s[order], n - -(-2 * percent * n // (100 + percent)) + 1, float(common[order].mean())


def bitmap(s: np.ndarray) -> bytes:
    bits = 1 << int(np.ceil(np.log2(max(BITS[0], min(BITS[1], 4 * len(s))))))
    out = np.zeros(bits, bool)
    out[(s >> np.uint64(24)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """A row of ``width`` bytes for each bitmap of that many bytes or more: halves are laid upon each other."""
    out = np.empty((len(maps), width), np.uint8)
    lengths = np.fromiter(map(len, maps), np.int64, len(maps))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        wide = np.frombuffer(b"".join([maps[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), n)
        while wide.shape[1] > width:
            half = wide.shape[1] // 2
            wide = wide[:, :half] | wide[:, half:]
        out[rows] = wide
    return out.view(np.uint64)


def can_link(x: np.ndarray, y: np.ndarray, maps: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bits of the pairs (x, y) of texts leave room for enough overlap."""
    ok = np.zeros(len(x), bool)
    length = np.fromiter(map(len, maps), np.int64, len(maps))
    width = np.minimum(length[x], length[y])
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        used, at = np.unique(np.concatenate([x[rows], y[rows]]), return_inverse=True)
        wide = folded([maps[i] for i in used.tolist()], w)
        step = max(1, CHUNK * 8 // w)
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            apart = np.bitwise_count(wide[at[k : k + len(r)]] ^ wide[at[len(rows) + k : len(rows) + k + len(r)]]).sum(axis=1, dtype=np.int64)
            total = sizes[x[r]] + sizes[y[r]]
            ok[r] = (total - apart) // 2 * (100 + percent) >= percent * total
    return ok


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: the common elements of two sorted arrays, against the union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of the shingles of all documents by bucket: BUCKETS numbers, whatever the input."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found = shingle_sets(batch.column(0).to_pylist(), size)
            total += np.bincount(np.concatenate([*found, np.zeros(0, np.uint64)]).astype(np.uint64) & np.uint64(BUCKETS - 1), minlength=BUCKETS)
        for at in np.flatnonzero(total.reshape(-1, SEGMENT).any(axis=1)).tolist():
            part = np.minimum(total[at * SEGMENT : (at + 1) * SEGMENT], (1 << 32) - 1).astype("<u4")
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[at] = held.get(at, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        rows = [np.minimum(c, (1 << 32) - 1).astype("<u4").tobytes() for c in held.values()]
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array(rows, pa.binary())], names=["segment", "counts"])

    schema = "segment int, counts binary"
    out = np.zeros((BUCKETS // SEGMENT, SEGMENT), np.uint32)
    for r in docs.select("text").mapInArrow(count, schema).repartition("segment").mapInArrow(add, schema).collect():  # 4 MB
        out[r["segment"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def band_of(size, percent: int):
    """Bands of sizes: texts that can link are in the same or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int")


def allowed(x_size, x_low, y_size, y_low, percent: int):
    """Whether sizes are near enough, and the key is among the first of the smaller one."""
    near = 100 * F.least(x_size, y_size) >= percent * F.greatest(x_size, y_size)
    return near & ((x_low & (x_size <= y_size)) | (y_low & (y_size <= x_size)))


def star_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b: each text of a key with its most common one. Rows are (key, doc, low, size, common)."""
    hub = rows.groupBy("key").agg(F.max_by(F.struct("doc", "low", "size"), F.struct("common", "doc")).alias("h"))
    met = rows.join(hub, "key").filter("doc <> h.doc").filter(allowed(F.col("size"), F.col("low"), F.col("h.size"), F.col("h.low"), percent))
    return met.select(F.least("doc", "h.doc").alias("a"), F.greatest("doc", "h.doc").alias("b")).distinct()


def bounded(edges: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The edges whose bitmaps leave room for enough overlap; ``maps`` has (doc, size, bits)."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()]).astype(np.int64)
            ok = can_link(np.arange(len(a)), np.arange(len(a), 2 * len(a)), batch.column(3).to_pylist() + batch.column(5).to_pylist(), sizes, percent)
            yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    left = maps.select(F.col("doc").alias("a"), F.col("size").alias("m"), F.col("bits").alias("p"))
    right = maps.select(F.col("doc").alias("b"), F.col("size").alias("n"), F.col("bits").alias("q"))
    return edges.join(left, "a").join(right, "b").select("a", "b", "m", "p", "n", "q").mapInArrow(run, "a long, b long")


# Tiles


def _tiles(percent: int):
    """Pairs (a, b) of each cell: every visitor with every text that lives there, in other components.

    Rows (key, band, cell, visits, doc, low, group, size, lives, bits) stand in order of the first four.
    """

    def meet(live, visit, maps):
        # number of the cell, doc, low, group, size, major, place of the bitmap
        first, end = np.searchsorted(live[0], visit[0], "left"), np.searchsorted(live[0], visit[0], "right")
        count = end - first
        total = np.cumsum(count)
        sizes = np.empty(len(maps), np.int64)
        sizes[live[6]], sizes[visit[6]] = live[4], visit[4]
        begin = 0
        while begin < len(total):
            done = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, done + CHUNK, "right")))
            c = count[begin:stop]
            v = np.repeat(np.arange(begin, stop), c)
            h = np.arange(len(v)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[begin:stop], c)
            begin = stop
            m, n = live[4][h], visit[4][v]
            # Two texts outside the key's major component visit each other; one of the two meetings counts.
            ok = (live[3][h] != visit[3][v]) & (live[5][h] | (visit[1][v] < live[1][h])) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
            ok &= (live[2][h] & (m <= n)) | (visit[2][v] & (n <= m))
            h, v = h[ok], v[ok]
            ok = can_link(live[6][h], visit[6][v], maps, sizes, percent)
            x, y = live[1][h[ok]], visit[1][v[ok]]
            if len(x):
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches):
        home: list[np.ndarray] | None = None
        home_maps: list[bytes] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, band, cell, doc, group, size = (batch.column(i).to_numpy() for i in (0, 1, 2, 4, 6, 7))
            visits, low, major = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 8))
            maps = home_maps + batch.column(9).to_pylist()
            new = np.append([last != (key[0], band[0], cell[0])], (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (cell[1:] != cell[:-1]))
            number = np.cumsum(new)  # 0 is the cell that the last batch ended with
            columns = (number, doc, low, group, size.astype(np.int64), major, len(home_maps) + np.arange(len(key)))
            live = [c[~visits] for c in columns]
            if home is not None:
                live = [np.concatenate(x) for x in zip(home, live, strict=True)]
            yield from meet(live, [c[visits] for c in columns], maps)
            stays = live[0] == number[-1]
            home = [c[stays] for c in live]
            home_maps = [maps[i] for i in home[6].tolist()]
            home[0], home[6] = np.zeros_like(home[0]), np.arange(len(home_maps))
            last = (key[-1], band[-1], cell[-1])

    return run


def tile_edges(rows: DataFrame, maps: DataFrame, percent: int, cell: int = CELL, few: int = FEW) -> DataFrame:
    """Distinct (a, b), a < b, of all texts in different components that share a key and can link.

    Rows are (key, doc, low, group, size). A text lives in a cell of its key and band; texts outside the key's
    largest component visit all cells of their band and its neighbours. Texts of keys with at most ``few`` rows
    meet by the key alone, and their bitmaps after each pair was made one.
    """
    counts = rows.groupBy("key", "group").agg(F.count("*").alias("n"), F.max("low").alias("low"))
    keys = counts.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("major"), F.count("*").alias("groups"), F.sum("n").alias("n"), F.max("low").alias("low"))
    keys = keys.filter("groups > 1 AND low").select("key", "major", (F.col("n") <= few).alias("few"))
    met = materialise(rows.join(keys, "key"), "contested-rows")

    side = met.filter("few").select("key", "doc", "low", "group", "size")
    other = side.select("key", *[F.col(c).alias(f"o_{c}") for c in ("doc", "low", "group", "size")])
    alone = side.join(other, "key").filter((F.col("doc") < F.col("o_doc")) & (F.col("group") != F.col("o_group")))
    alone = alone.filter(allowed(F.col("size"), F.col("low"), F.col("o_size"), F.col("o_low"), percent))
    alone = bounded(alone.select(F.col("doc").alias("a"), F.col("o_doc").alias("b")).distinct(), maps, percent)

    met = met.filter("NOT few").withColumn("band", band_of(F.col("size"), percent)).withColumn("lives", F.col("group") == F.col("major"))
    met = materialise(met.drop("major", "few").join(maps.select("doc", "bits"), "doc"), "tiled-rows")
    bands = materialise(met.groupBy("key", "band").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells")), "bands")
    columns = ["doc", "low", "group", "size", "lives", "bits"]
    live = met.join(bands, ["key", "band"]).select("key", "band", F.pmod(F.xxhash64("doc"), F.col("cells")).cast("int").alias("cell"), F.lit(False).alias("visits"), *columns)
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    visit = met.filter("not lives").select("key", near, *columns).join(bands, ["key", "band"])
    visit = visit.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(True).alias("visits"), *columns)
    dealt = live.unionByName(visit).repartition("key", "band", "cell").sortWithinPartitions("key", "band", "cell", "visits")
    tiled = materialise(dealt.mapInArrow(_tiles(percent), "a long, b long").distinct(), "tiles")
    return tiled.unionByName(alone).distinct()


# Verification


def verified(edges: DataFrame, packed: DataFrame, percent: int, size: int) -> DataFrame:
    """The edges whose sets overlap enough; ``packed`` has (doc, packed), the compressed texts."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = dict(zip(a + b, batch.column(2).to_pylist() + batch.column(3).to_pylist(), strict=True))
            unpack = zstandard.ZstdDecompressor()
            sets = dict(zip(texts, shingle_sets([unpack.decompress(t).decode("utf-8") for t in texts.values()], size), strict=True))
            ok = np.array([linked(sets[x], sets[y], percent) for x, y in zip(a, b, strict=True)], bool)
            yield pa.record_batch([pa.array(np.array(a, np.int64)[ok]), pa.array(np.array(b, np.int64)[ok])], names=["a", "b"])

    left = packed.select(F.col("doc").alias("a"), F.col("packed").alias("p"))
    right = packed.select(F.col("doc").alias("b"), F.col("packed").alias("q"))
    return edges.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def node(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE, max_broadcast_ids: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the least identifier that links reach."""
    spark = docs.sparkSession
    arrow_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    base = docs.select(doc.alias("id"), F.xxhash64(doc, text).alias("row"), text.alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(base, size))

    def describe(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), size)
            keys = [keys_of(s, counts.value, percent) if len(s) else (s, 0, 0.0) for s in sets]
            columns = [
                pa.array([node(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([k[:low].tobytes() for k, low, _ in keys], pa.binary()),
                pa.array([k[low:].tobytes() for k, low, _ in keys], pa.binary()),
                pa.array([c for _, _, c in keys], pa.float64()),
                pa.array([bitmap(s) for s in sets], pa.binary()),
            ]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["id", "row", "node", "size", "low_keys", "high_keys", "common", "bits"])

    schema = "id long, row long, node binary, size int, low_keys binary, high_keys binary, common double, bits binary"
    described = materialise(base.mapInArrow(describe, schema), "shingles")
    least = F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("least")
    firsts = [F.first(c).alias(c) for c in ("size", "low_keys", "high_keys", "common", "bits")]
    texts = described.filter("size > 0").groupBy("node").agg(F.min("row").alias("row"), *firsts, least)
    # From here to the components a text is named by a number of its own, as long as the table stands.
    texts = materialise(texts.withColumn("doc", F.monotonically_increasing_id()), "texts")
    # Twice the number, and one more for keys that count where the text is the smaller one.
    keyed = texts.select((2 * F.col("doc") + 1).alias("doc"), F.col("low_keys").alias("keys")).unionByName(texts.select((2 * F.col("doc")).alias("doc"), F.col("high_keys").alias("keys")))
    shared = shared_keys(keyed.filter(F.length("keys") > 0), parts).select("key", F.shiftright("doc", 1).alias("doc"), (F.col("doc") % 2 == 1).alias("low"))
    shared = materialise(shared.join(texts.select("doc", "size", "common"), "doc"), "shared")
    maps = texts.select("doc", "size", "bits")

    @F.arrow_udf("binary")
    def pack(text: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=1)
        return pa.array([squeeze.compress(t.encode("utf-8")) for t in text.to_pylist()], pa.binary())

    tested = links = None
    for step in ("stars", "tiles"):
        if step == "stars":
            edges = bounded(star_edges(shared, percent), maps, percent)
        else:
            edges = materialise(tile_edges(shared.drop("common").join(labels, "doc"), maps, percent), "tile-pairs").join(tested, ["a", "b"], "left_anti")
        edges = tested = materialise(edges, "candidates")
        ends = edges.select(F.col("a").alias("doc")).unionByName(edges.select(F.col("b").alias("doc"))).distinct()
        # Up to ``max_broadcast_ids`` rows are sent to the texts; beyond, both are shuffled.
        few = materialise(texts.select("doc", "row").join(ends, "doc"), "ends")
        few = F.broadcast(few) if few.count() <= max_broadcast_ids else few.hint("merge")
        packed = materialise(base.join(few, "row").select("doc", pack("text").alias("packed")).dropDuplicates(["doc"]), "packed")
        found = materialise(verified(edges, packed, percent, size), "links")
        links = found if links is None else links.unionByName(found)
        roots = components(links).withColumnRenamed("node", "doc")
        labels = materialise(texts.select("doc").join(roots, "doc", "left").select("doc", F.coalesce("root", "doc").alias("group")), "labels")
    named = materialise(texts.select("doc", "node", "least").join(labels, "doc"), "named")
    found = named.groupBy("group").agg(F.min("least").alias("least"))
    classes = materialise(named.select("node", "group").join(found, "group").select("node", F.col("least.id").alias("component_id")), "classes")
    joined = described.select("id", "node", "size").join(classes, "node", "left")
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    return joined.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), own)


def op13_ngram_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return similar_groups(docs)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (max(m.n) + max(n.n) - count(*))
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least r ON r.x = d.doc_id
"""
