"""Streaming queries on tables of many files."""

import datetime
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException

from cairn.plans import registry
from cairn.streaming import tables


def test_first_lookups_count_late_events(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(140):  # 64 files a batch; those of the last one are a year older
        ts = datetime.datetime(2024 if i < 128 else 2023, 6, 1)
        row = {"event_id": [i, 0], "user_id": [1, 1], "event_type": ["view", "view"], "ts": [ts, ts]}
        pq.write_table(pa.table(row), folder / f"{i:03}.parquet")
        os.utime(folder / f"{i:03}.parquet", (1_700_000_000 + i,) * 2)
    got = registry.queries()["z07_first_lookups"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, "view", 140)]


def test_latest_by_key_over_many_batches_and_none(spark, tmp_path):
    folder = tmp_path / "events"
    want = {}
    for n in range(11):
        rows = [(k, 100 * n + k, f"{n}") for k in range(n % 4, 30, 3)]
        spark.createDataFrame(rows, "k long, seq long, v string").coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
        want |= {k: (s, v) for k, s, v in rows}
    stream = tables.read_stream(spark, str(folder), "events", files_per_trigger=1)
    got = tables.latest_by_key(stream, "k", "seq", ["v"], "latest-test", fanout=3)
    assert {r["k"]: (r["seq"], r["v"]) for r in got.collect()} == want
    empty = tmp_path / "none"
    spark.createDataFrame([], "k long, seq long, v string").write.parquet(str(empty / "events.parquet"))
    assert tables.latest_by_key(tables.read_stream(spark, str(empty), "events"), "k", "seq", ["v"], "latest-none").count() == 0


def land(spark, folder, rows, schema, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(f"{folder}/events.parquet")
    return tables.read_stream(spark, str(folder), "events", files_per_trigger=1)


def test_resumed_upserts_come_from_the_folder(spark, tmp_path):
    """A run ends in its third batch, once before and once after the entry; a later object finds the table."""
    schema, want = "k long, seq long, v string", {}

    def rows(n):
        made = [(k, 10 * n + k % 7, f"{n}") for k in range(n % 3, 40, 2)]
        for k, s, v in made:
            if k not in want or s > want[k][0]:
                want[k] = (s, v)
        return made

    made = [rows(n) for n in range(5)]
    for part in made:
        stream = land(spark, tmp_path / "in", part, schema)
    for late in (False, True):
        sink = tables.LatestTable(spark, str(tmp_path / "table"), "k", "seq", ["v"], fanout=3)
        write = sink.handle

        def handle(batch, number, write=write, late=late):
            if number == (3 if late else 2) and not late:
                raise RuntimeError("stopped")
            write(batch, number)
            if number == 3 and late:
                raise RuntimeError("stopped")

        sink.handle = handle
        with pytest.raises(StreamingQueryException):
            sink.update(stream)
    assert 3 in sink.ledger.done() and 4 not in sink.ledger.done()
    stream = land(spark, tmp_path / "in", rows(9), schema)
    again = tables.LatestTable(spark, str(tmp_path / "table"), "k", "seq", ["v"], fanout=3)
    again.update(stream)
    got = tables.LatestTable(spark, str(tmp_path / "table"), "k", "seq", ["v"]).read(stream.schema)
    assert {r["k"]: (r["seq"], r["v"]) for r in got.collect()} == want
    assert [e["number"] for e in again.ledger.entries() if not e["replaces"]] == list(range(6)) and len(again.ledger.parts()) < 4


def test_run_to_table_goes_on(spark, tmp_path):
    schema = "k long"
    for run in range(3):
        stream = land(spark, tmp_path / "in", [(10 * run + i,) for i in range(10)], schema, files=2)
        got = tables.run_to_table(stream, "go-on", folder=str(tmp_path / "out"))
        assert sorted(r["k"] for r in got.collect()) == list(range(10 * run + 10))


def test_first_seen_over_runs(spark, tmp_path):
    """Repeated and late events of a second run: the state of the first one tells which are earlier."""
    at = lambda d: datetime.datetime(2024, 1, d)
    schema = "pair string, ts timestamp, event_id long"
    for run, rows in enumerate([[("a", at(5), 5), ("a", at(7), 7), ("b", at(9), 1), (None, at(2), 3), ("d", None, 4)], [("a", at(5), 5), ("a", at(3), 8), ("b", at(9), 2), ("c", at(1), 6), ("a", at(6), 9)]]):
        stream = land(spark, tmp_path / "in", rows, schema)
        got = tables.first_seen(stream, "pair", "ts", "event_id", "firsts", keep="1 days", folder=str(tmp_path / "out"))
        found = sorted(((r["key"], r["ts"].day, r["event_id"]) for r in got.collect()), key=str)
        first = [("a", 5, 5), ("b", 9, 1), (None, 2, 3)]
        assert found == sorted(first if run == 0 else [*first, ("a", 3, 8), ("c", 1, 6)], key=str)


def test_first_seen_forgets(spark, tmp_path):
    """State that has outlived its time is gone: the key's next event is given out again, and the least one stays the first."""
    schema = "pair string, ts timestamp, event_id long"
    for run in range(2):
        stream = land(spark, tmp_path / "in", [("a", datetime.datetime(2024, 1, 5 + run), run)], schema)
        got = tables.first_seen(stream, "pair", "ts", "event_id", "firsts", keep="1 seconds", folder=str(tmp_path / "out"))
        time.sleep(2)
    assert sorted(r["event_id"] for r in got.collect()) == [0, 1]
