"""Small helpers to fit and hold out labelled rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int = 5) -> Column:
    """The row's fold: crc32 of the identifier as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: list[int], max_rows: int) -> DataFrame:
    """(text, y, turn, own) of the documents of at most ``max_rows`` labelled identifiers a class.

    Labels are taken in the order of a hash of the identifier, ``turn``, so the sample does not
    depend on how the tables are stored; ``own`` is a hash of the text. Only the chosen
    identifiers, at most twice ``max_rows``, are sent to the documents, whose texts may be of any
    length and stay where they are. Rows that repeat an identifier all count here; what is
    gathered from them is bounded where it is gathered.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter("y is not null and doc_id is not null")
    known = known.filter(fold(F.col("doc_id")).isin(folds)).withColumn("turn", F.xxhash64("doc_id"))
    parts = [known.filter(F.col("y") == y).orderBy("turn", "doc_id").limit(max_rows) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).groupBy("doc_id", "turn").agg(F.max("y").alias("y"))
    rows = docs.select("doc_id", "text").filter("text is not null")
    return rows.join(F.broadcast(chosen), "doc_id").select("text", "y", "turn", F.xxhash64("text").alias("own"))


def measured(sample: DataFrame, features: int, measure, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a sample, measured by tasks; at most ``max_rows`` rows a class come back."""
    names = [f"x{k}" for k in range(features)]

    def run(batches):
        for batch in batches:
            x = measure(batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(1), batch.column(2), batch.column(3), *[pa.array(x[:, k]) for k in range(features)]], names=["y", "turn", "own", *names])

    rows = sample.select("text", "y", "turn", "own").mapInArrow(run, "y int, turn long, own long, " + ", ".join(f"{n} double" for n in names))
    parts = [rows.filter(F.col("y") == y).orderBy("turn", "own", *names).limit(max_rows) for y in (0, 1)]
    found = parts[0].unionByName(parts[1]).toPandas()
    return found[names].to_numpy(float).reshape(-1, features), found["y"].to_numpy(float)


def class_totals(labels: DataFrame, label: str, folds: list[int]) -> dict[int, int]:
    """How many labelled rows of either class the folds hold."""
    known = labels.filter(fold(F.col("doc_id")).isin(folds)).select(F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    return {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}


def class_weights(y: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights that bring a sample of y back to the classes' shares, with mean 1."""
    held = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    w = np.where(y == 1, totals.get(1, 0) / held[1], totals.get(0, 0) / held[0])
    return w / w.mean() if len(w) and w.mean() > 0 else np.ones(len(y))


class Logistic:
    """Ridge logistic regression on standardised features, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30):
        v = np.ones(len(y)) if weights is None else weights
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        spread = x.std(axis=0) if len(x) else np.ones(x.shape[1])
        self.spread = np.where(spread > 1e-12, spread, 1.0)
        # Half a row of either class keeps scores inside (0, 1) where a class is missing.
        prior = ((v * y).sum() + 0.5) / (v.sum() + 1)
        self.w = np.zeros(x.shape[1] + 1)
        self.w[0] = np.log(prior / (1 - prior))
        if len(np.unique(y)) < 2:
            return
        z = self._design(x)
        penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -35, 35)))
            step = np.linalg.solve(z.T * (v * p * (1 - p)) @ z + penalty, z.T @ (v * (y - p)) - penalty @ self.w)
            self.w = self.w + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -35, 35)))
