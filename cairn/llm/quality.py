"""Quality classifier by compression with zstandard dictionaries.

One dictionary is built from texts labelled good and one from texts labelled bad. A text is
compressed with either; the difference of the sizes, normalised by the text's length and by the
sizes' sum, says which it resembles. With the size by no dictionary and the length, which tell
how repetitive the text is, that difference is calibrated by a logistic regression to the
probability of label 1. Dictionaries and calibration use different folds.

The sample is bounded: at most ``max_rows`` labelled rows a class for dictionaries and for
calibration each. Rows may be of any length: texts for the dictionaries are cut into pieces of
``piece_bytes``, and ``max_pieces`` of a class are taken, in turns of one piece a text.

Cases: null and empty texts are scored alike, as an empty text; without labels of both classes
every score is the share of label 1 (0.5 without any); texts of any length are compressed whole;
repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.calibrate import Logistic, class_totals, class_weights, fold, labelled_sample, measured
from cairn.session import arrow_batches

FEATURES = 5


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of too few texts their last bytes, as raw content."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


class Compressors:
    """The compressors of one Python worker."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.all = []
        for raw in (good, bad):
            if raw:
                data = zstandard.ZstdCompressionDict(raw)
                data.precompute_compress(level=level)
                self.all.append(zstandard.ZstdCompressor(level=level, dict_data=data))
            else:
                self.all.append(zstandard.ZstdCompressor(level=level))
        self.all.append(zstandard.ZstdCompressor(level=level))

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty((len(texts), FEATURES))
        for i, t in enumerate(texts):
            raw = b"" if t is None else t.encode("utf-8")
            good, bad, plain = (len(c.compress(raw)) for c in self.all)
            n = len(raw) + 20
            apart = (bad - good) / (bad + good)
            out[i] = (bad - good) / n, apart, np.log(plain / n), np.log(n), np.log(plain / n) * np.log(n)
        return out


class QualityModel:
    """Dictionaries and calibration; the compressors are made where a task runs."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.logistic, self._made = good, bad, None, None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def features(self, texts: list[str | None]) -> np.ndarray:
        if self._made is None:
            self._made = Compressors(self.good, self.bad)
        return self._made.features(texts)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.logistic.predict(self.features(texts)) if texts else np.zeros(0)


def pieces(sample: DataFrame, piece_bytes: int, max_pieces: int) -> dict[int, list[bytes]]:
    """Pieces of the sample's texts by class, at most ``max_pieces`` each, in the order of (turn, hash)."""

    def cut(batches):
        for batch in batches:
            turns, ys, raws = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8")
                own = sorted({raw[i : i + piece_bytes] for i in range(0, len(raw), piece_bytes)}, key=lambda x: hashlib.blake2b(x, digest_size=8).digest())
                for turn, piece in enumerate(own[:max_pieces]):
                    turns.append(turn)
                    ys.append(y)
                    raws.append(piece)
            yield pa.record_batch([pa.array(turns, pa.int32()), pa.array(ys, pa.int32()), pa.array(raws, pa.binary())], names=["piece_turn", "y", "piece"])

    rows = sample.select("text", "y").mapInArrow(cut, "piece_turn int, y int, piece binary").withColumn("own", F.xxhash64("piece"))
    return {y: [bytes(r["piece"]) for r in rows.filter(F.col("y") == y).orderBy("piece_turn", "own", "piece").limit(max_pieces).collect()] for y in (0, 1)}


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 1200, dictionary_bytes: int = 65_536, piece_bytes: int = 4096, max_pieces: int = 2400) -> QualityModel:
    """Fit on a bounded sample of the labelled rows of folds 1 to 4."""
    texts = pieces(labelled_sample(docs, labels, "quality", [1, 2], max_rows), piece_bytes, max_pieces)
    model = QualityModel(dictionary(texts[1], dictionary_bytes), dictionary(texts[0], dictionary_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    x, y = measured(labelled_sample(docs, labels, "quality", [3, 4], max_rows), FEATURES, lambda texts: sent.value.features(texts), max_rows)
    model.logistic = Logistic(x, y, class_weights(y, class_totals(labels, "quality", [3, 4])))
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Each row as struct ``row`` with ``score``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def apply(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(text.to_pylist()))

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.withColumn("score", apply(F.col("row.text")))


def op5_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the contract; 0.3 is its threshold."""
    arrow_batches(spark)
    found = score(docs, train(docs, labels))
    doc = F.col("row.doc_id")
    return found.select(doc.alias("doc_id"), (fold(doc) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
