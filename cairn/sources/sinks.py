"""Sinks as set operations: each gives the table after the change, for the caller to write."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.session import materialise


def split_rejects(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the names of the checks they fail."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("failed", failed)
    return marked.filter(F.size("failed") == 0).drop("failed"), marked.filter(F.size("failed") > 0)


def insert_batches(rows: DataFrame, target: T.StructType, batch_rows: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rows as the typed ``target`` takes them, and (row, error) of those that it refuses; ``row`` is JSON.

    Rows are cast a batch at a time. A batch that fails is halved until single rows fail, so the other rows
    of a bad batch are inserted, and the number of casts grows with the bad rows times the logarithm of
    the batch. A cast that loses anything fails, and so does a null where the target has none. The outcome
    is written once, as a table from which both frames are read.
    """
    arrow = to_arrow_schema(target)
    names = [f.name for f in target.fields]

    def typed(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = []
        for field in arrow:
            column = batch.column(field.name).cast(field.type, safe=True)
            if not field.nullable and column.null_count:
                raise ValueError(f"null in column {field.name}")
            columns.append(column)
        return pa.record_batch(columns, schema=arrow)

    def tried(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, str | None]]:
        try:
            yield typed(batch), None
        except (pa.ArrowException, ValueError) as error:
            if batch.num_rows == 1:
                yield batch, str(error)
                return
            half = batch.num_rows // 2
            yield from tried(batch.slice(0, half))
            yield from tried(batch.slice(half))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                for part, error in tried(whole.slice(at, batch_rows)):
                    n = part.num_rows
                    good = part if error is None else pa.record_batch([pa.nulls(n, f.type) for f in arrow], names=names)
                    raw = pa.nulls(n, pa.string()) if error is None else pa.array([json.dumps(r, default=str, ensure_ascii=False) for r in part.to_pylist()])
                    values = pa.StructArray.from_arrays([good.column(i) for i in range(len(names))], names=names)
                    yield pa.record_batch([values, raw, pa.array([error] * n, pa.string())], names=["good", "row", "error"])

    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in target.fields])
    schema = T.StructType([T.StructField("good", loose), T.StructField("row", T.StringType()), T.StructField("error", T.StringType())])
    done = materialise(rows.select(*names).mapInArrow(run, schema), "inserted")
    return done.filter("error IS NULL").select("good.*"), done.filter("error IS NOT NULL").select("row", "error")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key does not come in, and one incoming row a key, the greatest if there are several."""
    others = [c for c in incoming.columns if c not in keys]
    incoming = incoming.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*") if others else incoming.select(*keys).distinct()
    return existing.join(incoming.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(incoming.select(*existing.columns))


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All existing rows and the incoming ones whose key is new."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def update(existing: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns take the change's value where the key has one that is not null."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = existing.join(new, keys, "left")
    return joined.select(*[(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c)) for c in existing.columns])


def delete(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Children without the keys first, then the parent without them."""
    out = {name: child.join(keys.select(F.col(key).alias(fk)), fk, "left_anti") for name, (child, fk) in children.items()}
    return out | {"parent": parent.join(keys.select(key), key, "left_anti")}


def soft_delete(rows: DataFrame, keys: DataFrame, key: str, at: Column) -> DataFrame:
    """``deleted_at`` set for the keys; rows deleted before keep their date, other rows stay as they are."""
    return _deleted(rows, keys, key, F.coalesce("deleted_at", at))


def restore(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``deleted_at`` null for the keys; other rows stay as they are."""
    return _deleted(rows, keys, key, F.lit(None))


def _deleted(rows: DataFrame, keys: DataFrame, key: str, value: Column) -> DataFrame:
    named = keys.select(key).distinct().withColumn("_named", F.lit(True))
    new = F.when(F.col("_named"), value).otherwise(F.col("deleted_at")).cast(rows.schema["deleted_at"].dataType)
    return rows.join(named, key, "left").withColumn("deleted_at", new).select(*rows.columns)


def write_with_envelope(rows: DataFrame, path: str, **metadata: str) -> None:
    """JSON lines below ``path``/rows and one metadata row with their count below ``path``/metadata."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    head = rows.agg(F.count("*").alias("count")).select("count", *[F.lit(v).alias(k) for k, v in metadata.items()])
    head.write.mode("overwrite").json(f"{path}/metadata")
