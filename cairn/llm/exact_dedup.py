"""Exact deduplication with a log-structured merge index of digests.

Rows are digested once and fed to the index in batches. A task fills a memtable (digest to best
identifier, its number of rows, number of all rows) and flushes it as a sorted run of at most
``memtable_rows`` entries. Runs are Parquet folders on levels; once a level holds ``fanout`` runs,
compaction merges them into one run of the next, keeping the smallest (or largest) identifier.
Identifier and size of each group come from the index. Its filter, a Bloom filter of the digests
that repeat, made block by block and sized by their number (at most ``max_filter_bits``), lets
most other rows pass by. Hits receive byte verification: the least and the greatest normalised
text of a digest must be the same bytes; digests for which they differ are grouped by the bytes.

Cases: a null text counts as empty; a null identifier is smaller than every other one; empty
texts form one group; rows that repeat both identifier and text count in ``group_size`` and one
of them is kept; an empty table gives an empty result; further columns, whatever their names,
travel in a struct; texts may be of any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import arrow_batches, materialise, shared_dir

RUN_SCHEMA = "digest binary, best long, n long, ties long"
BLOCK_BITS = 1 << 16


def normalise(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return b"" if text is None else text.encode("utf-8").lower()


def sha256(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


class DigestIndex:
    """Levelled runs of (digest, best identifier, count, rows with that identifier) below a shared folder."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", fanout: int = 3, memtable_rows: int = 100_000):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.keep, self.fanout, self.memtable_rows = spark, keep, fanout, memtable_rows
        self.levels: list[list[str]] = [[]]

    def add(self, batch: DataFrame) -> None:
        """Flush a batch of (id, digest) as a run of level 0."""
        limit, largest = self.memtable_rows, self.keep == "largest"

        def flush(batches):
            memtable: dict[bytes, list] = {}

            def run():
                order = sorted(memtable)
                columns = [pa.array(order, pa.binary()), *[pa.array([memtable[d][k] for d in order], pa.int64()) for k in range(3)]]
                memtable.clear()
                return pa.record_batch(columns, names=["digest", "best", "n", "ties"])

            for batch in batches:
                for i, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    entry = memtable.setdefault(digest, [i, 0, 0])
                    entry[1] += 1
                    if i == entry[0]:
                        entry[2] += 1
                    elif largest and (entry[0] is None or i is not None and i > entry[0]) or not largest and (i is None or entry[0] is not None and i < entry[0]):
                        entry[0], entry[2] = i, 1
                if len(memtable) >= limit:
                    yield run()
            if memtable:
                yield run()

        self._write(batch.select("id", "digest").mapInArrow(flush, RUN_SCHEMA), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                merged = self._merge(self._read(self.levels[level])).sortWithinPartitions("digest")
                self.levels[level] = []
                self._write(merged, level + 1)

    def _write(self, run: DataFrame, level: int) -> None:
        path = shared_dir(self.spark, f"digests-{level}")
        run.write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths)

    def _merge(self, runs: DataFrame) -> DataFrame:
        """One row a digest: the best identifier, a null one being the smallest, and sums."""
        rank = F.struct(F.col("best").isNotNull().alias("some"), "best")
        best = (F.max if self.keep == "largest" else F.min)(rank).alias("b")
        # Rows with the best identifier: those of the runs that have it, whichever it turns out to be.
        by_best = runs.groupBy("digest", "best").agg(F.sum("n").alias("n"), F.sum("ties").alias("ties"))
        pick = F.max_by if self.keep == "largest" else F.min_by
        return by_best.groupBy("digest").agg(best, F.sum("n").alias("n"), pick("ties", rank).alias("ties")).select("digest", "b.best", "n", "ties")

    def entries(self) -> DataFrame:
        """The whole index with one row a digest."""
        return self._merge(self._read([p for level in self.levels for p in level]))


def bloom_positions(digests: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each digest and three bits in it."""
    raw = np.frombuffer(b"".join(d.ljust(32, b"\0") for d in digests), "<u8").reshape(-1, 4)
    return (raw[:, 0] % np.uint64(blocks)).astype(np.int64), (raw[:, 1:] % np.uint64(BLOCK_BITS)).astype(np.int64)


def repeated_filter(repeated: DataFrame, max_filter_bits: int, bits_each: int = 16) -> np.ndarray:
    """A Bloom filter of the digests, a row a block, of ``bits_each`` bits a digest within the bound.

    Blocks are dealt out to tasks, so that the driver gets each block once.
    """
    wanted = max(1, -(-bits_each * repeated.count() // BLOCK_BITS))
    blocks = min(wanted, max(1, max_filter_bits // BLOCK_BITS))

    @F.arrow_udf("int")
    def block_of(digest: pa.Array) -> pa.Array:
        return pa.array(bloom_positions(digest.to_pylist(), blocks)[0], pa.int32())

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, bits = bloom_positions(batch.column(0).to_pylist(), blocks)
            for b in np.unique(at).tolist():
                own = bits[at == b].ravel()
                np.bitwise_or.at(held.setdefault(b, np.zeros(BLOCK_BITS // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    dealt = repeated.select("digest", block_of("digest").alias("block")).repartition("block").select("digest")
    for row in dealt.mapInArrow(fill, "block int, bits binary").collect():  # the filter itself, bounded
        out[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    return out


def mark_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256, batches: int = 4, batch_rows: int = 200_000_000, max_filter_bits: int = 1 << 27, **options) -> DataFrame:
    """Each row of ``df`` as struct ``row`` with keep_id, group_size, kept and digest.

    The index gets ``batches`` batches, or more of about ``batch_rows`` rows.
    """
    spark = df.sparkSession
    arrow_batches(spark)

    @F.arrow_udf("binary")
    def digested(text: pa.Array) -> pa.Array:
        return pa.array([digest(normalise(t)) for t in text.to_pylist()], pa.binary())

    keyed = materialise(df.select(F.col(id_col).cast("long").alias("id"), digested(F.col(text_col)).alias("digest")), "digests")
    batches = max(batches, -(-keyed.count() // batch_rows))
    index = DigestIndex(spark, keep, **options)
    for b in range(batches):
        index.add(keyed.filter(F.pmod(F.xxhash64("id", "digest"), F.lit(batches)) == b))
    repeated = materialise(index.entries().filter("n > 1"), "repeated")
    bitmap = spark.sparkContext.broadcast(repeated_filter(repeated, max_filter_bits))

    def probe(with_text: bool):
        @F.arrow_udf("struct<digest: binary, hit: boolean, norm: binary>")
        def run(text: pa.Array) -> pa.Array:
            norm = [normalise(t) for t in text.to_pylist()]
            found = [digest(t) for t in norm]
            at, bits = bloom_positions(found, len(bitmap.value))
            passes = (bitmap.value[at[:, None], bits >> 3] >> (bits & 7) & 1).all(axis=1)
            kept = [t if p and with_text else None for t, p in zip(norm, passes.tolist(), strict=True)]
            return pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(passes), pa.array(kept, pa.binary())], names=["digest", "hit", "norm"])

        return run

    texts = df.select(probe(True)(F.col(text_col)).alias("p")).select("p.digest", "p.norm").filter("norm is not null")
    # Tasks reduce their copies to two texts a digest before the shuffle.
    ends = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    broken = materialise(ends.filter("low <> high").select("digest"), "unequal")

    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), probe(False)(F.col(text_col)).alias("p"))
    rows = rows.select("row", "p.digest", "p.hit", F.col(f"row.`{id_col}`").cast("long").alias("id"))
    whole = repeated.join(broken, "digest", "left_anti")
    own = F.coalesce("n", F.lit(1)).cast("long").alias("group_size")
    best = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best")).alias("keep_id")
    marked = rows.filter("hit").join(materialise(whole, "groups"), "digest", "left").withColumn("ties", F.coalesce("ties", F.lit(1)))
    alone = rows.filter("not hit").select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    parts = [alone]
    if not broken.isEmpty():
        unequal = rows.filter("hit").join(broken, "digest", "left_semi").withColumn("norm", probe(True)(F.col(f"row.`{text_col}`"))["norm"])
        marked = marked.join(broken, "digest", "left_anti")
        rank = F.struct(F.col("id").isNotNull().alias("some"), "id")
        sizes = unequal.groupBy("digest", "norm", "id").agg(F.count("*").alias("m"))
        pick, extreme = (F.max_by, F.max) if keep == "largest" else (F.min_by, F.min)
        groups = sizes.groupBy("digest", "norm").agg(extreme(rank)["id"].alias("best"), F.sum("m").alias("n"), pick("m", rank).alias("ties"))
        parts.append(_keep_one(unequal.join(materialise(groups, "groups"), ["digest", "norm"]), ["digest", "norm"], best, own, True))
    parts.append(_keep_one(marked, ["digest"], best, own, not whole.filter("ties > 1").isEmpty()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _keep_one(rows: DataFrame, group: list[str], best: Column, size: Column, tied: bool) -> DataFrame:
    """The rows of groups with ``kept``: one of those that have the group's identifier."""
    is_best = F.col("id").eqNullSafe(F.col("keep_id"))
    rows = rows.select("row", best, size, "digest", "id", "ties", *[c for c in group if c != "digest"])
    columns = ["row", "keep_id", "group_size", "kept", "digest"]
    single = rows.filter("ties = 1").withColumn("kept", is_best).select(*columns)
    if not tied:
        return single
    # Rows that repeat the identifier that stays are numbered once, in a written table; the least number stays.
    many = materialise(rows.filter("ties > 1").withColumn("number", F.monotonically_increasing_id()), "ties")
    least = materialise(many.filter(is_best).groupBy(*group).agg(F.min("number").alias("least")), "least")
    return single.unionByName(many.join(least, group).withColumn("kept", F.col("number") == F.col("least")).select(*columns))


def op6_exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest columns of the contract: the largest doc_id of equal texts stays."""
    marked = mark_exact(docs, keep="largest")
    return marked.select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
