"""Structured Streaming over a folder of Parquet files."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cairn.session import shared_dir


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """The table as a stream; ``files_per_trigger`` limits the rate."""
    path = f"{sf_dir}/{name}.parquet"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_table(stream: DataFrame, tag: str, mode: str = "append", folder: str | None = None, timed: bool = False) -> DataFrame:
    """Process all that is there, exactly once, into a Parquet table below ``folder``.

    Progress and state stand beside the rows, so that another run with the same folder, after an end
    or a failure, goes on with what is new. Without a folder the run is one of its own. State that
    depends on the clock (``timed``) asks for batches without end, so such a run ends once batches
    find no new rows.
    """
    spark = stream.sparkSession
    folder = folder or shared_dir(spark, tag)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log")
    if timed:
        _until_idle(writer)
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _until_idle(writer) -> None:
    query = writer.trigger(processingTime="0 seconds").start()
    while query.isActive:
        # The first batch can be one that an earlier run had planned, so only a second one without rows is the end.
        last = query.recentProgress[-2:]
        if len(last) == 2 and all(p["numInputRows"] == 0 for p in last):
            query.stop()
        time.sleep(0.2)
    if query.exception():
        raise query.exception()


def run_batches(stream: DataFrame, tag: str, handle: Callable[[DataFrame, int], None], mode: str = "append", folder: str | None = None) -> None:
    """Give each micro-batch to ``handle``; with a folder, a later run goes on after the last batch that ended."""
    log = f"{folder or shared_dir(stream.sparkSession, tag)}/log"
    query = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()


class Ledger:
    """Small files that say which parts make up a table: (number, part, parts that it replaces).

    An entry is written under another name and then renamed, so that it is there as a whole or not
    at all. The table is what the folder says, whichever process reads it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._folder = folder
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def entries(self) -> list[dict]:
        found = []
        for status in self._fs.listStatus(self._path(self._folder)):
            if status.getPath().getName().endswith(".json"):
                stream = self._fs.open(status.getPath())
                found.append(json.loads(bytes(stream.readAllBytes())))
                stream.close()
        return sorted(found, key=lambda e: (e["number"], e["part"]))

    def add(self, number: int, part: str, replaces: list[str]) -> None:
        name = f"{self._folder}/{part}"
        stream = self._fs.create(self._path(f"{name}.tmp"), True)
        stream.write(bytearray(json.dumps({"number": number, "part": part, "replaces": replaces}).encode()))
        stream.close()
        self._fs.delete(self._path(f"{name}.json"), False)
        self._fs.rename(self._path(f"{name}.tmp"), self._path(f"{name}.json"))

    def done(self) -> set[int]:
        """Numbers of the batches whose rows are in the table."""
        return {e["number"] for e in self.entries()}

    def parts(self) -> list[str]:
        """The parts that no other one replaces."""
        entries = self.entries()
        gone = {p for e in entries for p in e["replaces"]}
        return [e["part"] for e in entries if e["part"] not in gone]


class LatestTable:
    """A buffered upsert sink in a folder: the last row a key, whichever micro-batch of whichever run brought it.

    A batch writes its own last rows as a part and then an entry of the ledger; once ``fanout`` parts
    have come together they are merged into one. A batch that comes again after a failure is known by
    its number and left out; one that failed before its entry overwrites its part. Parts that a merge
    replaced stay in the folder, so that a reader which has listed them can end.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, seq: str, columns: list[str], fanout: int = 8):
        self.spark, self.folder, self.key, self.seq, self.columns, self.fanout = spark, folder, key, seq, columns, fanout
        self.ledger = Ledger(spark, f"{folder}/ledger")

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.max(self.seq).alias(self.seq), F.max_by(F.struct(*self.columns), self.seq).alias("v")).select(self.key, self.seq, "v.*")

    def _part(self, name: str) -> str:
        return f"{self.folder}/parts/{name}"

    def handle(self, batch: DataFrame, number: int) -> None:
        if number not in self.ledger.done():
            self._latest(batch).write.mode("overwrite").parquet(self._part(f"{number}"))
            self.ledger.add(number, f"{number}", [])
        parts = self.ledger.parts()
        if len(parts) >= self.fanout:
            merged = f"{number}-merged"
            self._latest(self.spark.read.schema(self._schema(batch)).parquet(*map(self._part, parts))).write.mode("overwrite").parquet(self._part(merged))
            self.ledger.add(number, merged, parts)

    def _schema(self, rows: DataFrame):
        return rows.select(self.key, self.seq, *self.columns).schema

    def update(self, stream: DataFrame) -> None:
        """Take in all that is new in the stream."""
        run_batches(stream, "latest", self.handle, folder=self.folder)

    def read(self, schema) -> DataFrame:
        """The table as the folder has it; without any batch it is empty."""
        parts = self.ledger.parts()
        return self._latest(self.spark.read.schema(schema).parquet(*map(self._part, parts))) if parts else self.spark.createDataFrame([], schema)


def latest_by_key(stream: DataFrame, key: str, seq: str, columns: list[str], tag: str, fanout: int = 8, folder: str | None = None) -> DataFrame:
    """The last row a key after all of the stream, see :class:`LatestTable`."""
    spark = stream.sparkSession
    sink = LatestTable(spark, folder or shared_dir(spark, tag), key, seq, columns, fanout)
    sink.update(stream)
    return sink.read(stream.select(key, seq, *columns).schema)


# State


class FirstSeen(StatefulProcessor):
    """Of each key the earliest row so far: a row is given out when it comes before all that were seen.

    The state of a key is its earliest (time, identifier); with a time to live it is forgotten so long
    after its last change, which bounds the state. A forgotten key's next row is given out again, so the
    first of a key is the least row given out, however late rows come and whatever was forgotten.
    """

    def __init__(self, seq: str, tie: str, keep_ms: int | None):
        self.seq, self.tie, self.keep_ms = seq, tie, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", "at timestamp, tie long", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.least.get() if self.least.exists() else None
        best = None
        for part in rows:
            part = part[part[self.seq].notna() & part[self.tie].notna()]
            if len(part):
                row = part.sort_values([self.seq, self.tie]).iloc[0]
                at = (row[self.seq], int(row[self.tie]))
                best = at if best is None or at < best else best
        if best is not None and (before is None or best < (pd.Timestamp(before[0]), before[1])):
            self.least.update((best[0].to_pydatetime(), best[1]))
            yield pd.DataFrame({"key": [key[0]], self.seq: [best[0]], self.tie: [best[1]]})

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Queries that start meanwhile keep their state in RocksDB, on disk and outside the JVM's heap, and soon tell that they are idle."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataProgressEventInterval": "200"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def first_seen(stream: DataFrame, key: str, seq: str, tie: str, tag: str, keep: str | None = None, folder: str | None = None) -> DataFrame:
    """Rows (key, seq, tie) as they turned out to be the first of their key, one or more a key, written as a table.

    ``keep`` is how long a key's state lives after its last change, as an interval of seconds, minutes, hours or days;
    without it state stays for ever. Rows without a time or tie-breaker are left out.
    """
    spark = stream.sparkSession
    ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"key {fields[key]}, {seq} {fields[seq]}, {tie} {fields[tie]}"
    with state_in_rocksdb(spark):
        firsts = stream.groupBy(key).transformWithStateInPandas(statefulProcessor=FirstSeen(seq, tie, ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ms else "None")
        return run_to_table(firsts, tag, folder=folder, timed=bool(ms))
