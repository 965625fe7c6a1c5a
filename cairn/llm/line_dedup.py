"""Line deduplication over levelled sorted runs of line hashes.

Every line of at least ``min_chars`` code points has a key (ASCII white space stripped at both
ends, A-Z lower-cased) and a 128-bit hash of it. Documents arrive in batches, those with the
largest identifiers first. A batch is reduced to one row a hash (number of documents, largest
identifier) and merge-anti-joined with the runs: a line that no run has is new, and the batch's
largest document is the one that keeps it. The batch is then added as a sorted run of level 0; a
level that holds ``fanout`` runs is compacted into one run of the next. Runs are tables bucketed
and sorted by hash, so the joins move the batch only. Lines in at least ``min_docs`` documents,
counted over all runs, go from all documents but the one that keeps them.

Cases: a null or empty text is one empty line; a null identifier is smaller than every other and
counts as one document; rows that repeat an identifier count as one document and keep or lose a
line together; ties between documents cannot be, as identifiers decide; an empty table gives an
empty result; texts may be of any length; further columns, whatever their names, travel in a struct.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import arrow_batches, materialise, shared_dir

#: The white space that keys lose at both ends, and the smallest identifier.
STRIP = b" \t\n\x0b\x0c\r"
NULL_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None if the key is too short to count."""
    key = line.strip(STRIP)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars:
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The identifier, null as the smallest, and the hash by which a row is found again."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("at")]


def extract_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, at, key) with each key once a row of ``docs``."""

    def keys(parts):
        for part in parts:
            ids, rows, found = [], [], []
            for i, row, text in zip(*[part.column(k).to_pylist() for k in range(3)], strict=True):
                own = {line_key(x, min_chars) for x in text.encode("utf-8").split(b"\n")} if text else set()
                own.discard(None)
                ids += [i] * len(own)
                rows += [row] * len(own)
                found += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(found, pa.binary())], names=["doc", "at", "key"])

    return docs.select(*_rows(docs, id_col, text_col), F.col(text_col).alias("text")).mapInArrow(keys, "doc long, at long, key binary")


class LineIndex:
    """Levelled runs of (key, n_docs, keeper), tables bucketed by key in a shared folder.

    ``keeper`` is the document that keeps the line, null in all runs but the first that had it.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def entries(self) -> DataFrame:
        """One row a line over all runs."""
        return self._merge(self.runs())

    def add(self, batch: DataFrame) -> None:
        """Add the (doc, key) rows of documents that are smaller than those of all earlier batches."""
        counted = batch.select("doc", "key").distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))
        self._write(self._mark(counted), 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                self._write(self._merge(full), level + 1)
                self._drop(full)

    def _mark(self, counted: DataFrame) -> DataFrame:
        """The batch's lines; those that a run has do not get a keeper."""
        joined, known = counted, F.lit(False)
        for k, name in enumerate(self.runs()):
            joined = joined.join(self.spark.table(name).select("key", F.lit(True).alias(f"in_{k}")).hint("merge"), "key", "left")
            known = known | F.coalesce(f"in_{k}", F.lit(False))
        return joined.select("key", "n_docs", F.when(~known, F.col("max_doc")).alias("keeper"))

    def _merge(self, names: list[str]) -> DataFrame:
        # Read as files: Spark 4.1 groups a union of bucketed tables as if their buckets stood in one partition.
        runs = self.spark.read.schema("key binary, n_docs long, keeper long").parquet(*[self.paths[name] for name in names])
        return runs.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("keeper").alias("keeper"))  # one run has it

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_dir(self.spark, f"lines-{level}")
        run.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", self.paths[name]).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        """Take runs out of the catalogue; their files go with the session."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop(self.runs())


def _rewrite(min_chars: int, digest: bool):
    kind = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    @F.arrow_udf(kind)
    def rewrite(text: pa.Array, drop: pa.Array) -> pa.Array:
        lines_n, dropped_n, kept = [], [], []
        for t, gone in zip(text.to_pylist(), drop.to_pylist(), strict=True):
            raw = b"" if t is None else t.encode("utf-8")
            n = raw.count(b"\n") + 1
            dropped = 0
            if gone:
                out = set(gone)
                left = [x for x in raw.split(b"\n") if line_key(x, min_chars) not in out]
                dropped, raw = n - len(left), b"\n".join(left)
            lines_n.append(n)
            dropped_n.append(dropped)
            kept.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode("utf-8"))
        return pa.StructArray.from_arrays([pa.array(lines_n, pa.int64()), pa.array(dropped_n, pa.int64()), pa.array(kept, pa.string())], names=["n_lines", "n_dropped", "kept"])

    return rewrite


def batch_bounds(docs: DataFrame, batches: int, batch_rows: int) -> list[int]:
    """Identifiers, falling, that split the rows (doc) into at least ``batches`` parts of about equal size."""
    n = max(batches, -(-docs.count() // batch_rows))
    return [int(x) for x in reversed(docs.approxQuantile("doc", [k / n for k in range(1, n)], 0.25 / n))]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, batch_rows: int = 100_000_000, digest: bool = False) -> DataFrame:
    """Each row as struct ``row`` with n_lines, n_dropped and ``kept``: the text left, or its SHA-256.

    There are ``batches`` batches, or more of about ``batch_rows`` rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    lines = materialise(extract_keys(docs, id_col, text_col, min_chars), "line-keys")
    index = LineIndex(spark)
    high = None
    for low in [*batch_bounds(docs.select(_rows(docs, id_col, text_col)[0]), batches, batch_rows), None]:
        batch = lines if low is None else lines.filter(F.col("doc") > low)
        index.add(batch if high is None else batch.filter(F.col("doc") <= high))
        high = low
    frequent = materialise(index.entries().filter(F.col("n_docs") >= min_docs).select("key", "keeper"), "frequent-lines")  # so that the join can split a hot line
    index.close()
    drops = materialise(lines.join(frequent, "key").filter(F.col("doc") != F.col("keeper")).groupBy("doc", "at").agg(F.collect_set("key").alias("gone")), "drops")
    doc, at = _rows(docs, id_col, text_col)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), doc, at)
    joined = rows.join(drops, ["doc", "at"], "left")
    out = joined.select("row", _rewrite(min_chars, digest)(F.col(f"row.`{text_col}`"), F.col("gone")).alias("out"))
    return out.select("row", "out.n_lines", "out.n_dropped", "out.kept")


def op1_line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return dedup_lines(docs, digest=True).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH a AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM a)
), h AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT doc_id, i, line, h.key IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN h ON l.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
