"""Streams over ``events`` (Z, K10)."""

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.session import shared_dir
from cairn.streaming import tables as Z


def events(t):
    return Z.read_stream(t._spark, t._dir, "events")


@query("z02_exactly_once", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'")
def z02(t):
    return Z.run_to_table(events(t).filter("event_type <> 'error'").select("event_id", "event_type", "value"), "exactly-once")


class Stopped(Exception):
    """A run that ends before its stream does."""


def landed(t, folder: str, files: int, mode: str, half: str):
    """Half of the events as files of a folder that a stream reads, as a source would land them."""
    t.events.filter(half).repartition(files, "event_id").write.mode(mode).parquet(f"{folder}/in/events.parquet")
    return Z.read_stream(t._spark, f"{folder}/in", "events", files_per_trigger=2)


def stop_and_go(t, folder: str, run, batches: int = 2):
    """Land half of the events, end a run after some batches, land the rest, and run to the end."""
    stream = landed(t, folder, 8, "errorifexists", "event_id % 2 = 0")

    def stops(number: int) -> None:
        if number >= batches:
            raise Stopped("after some batches")

    with contextlib.suppress(StreamingQueryException):
        run(stream, stops)
    return run(landed(t, folder, 8, "append", "event_id % 2 <> 0"), lambda number: None)


@query("z02_resume", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def z02_resume(t):
    """Each event once, though the first run ends in the middle; the second one reads the same folder and log."""
    folder = shared_dir(t._spark, "resume")
    parts = Z.Ledger(t._spark, f"{folder}/ledger")

    def run(stream, stops):
        def handle(batch, number):
            stops(number)
            if number not in parts.done():  # a batch that comes again
                batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
                parts.add(number, f"{number}", [])

        rows = stream.filter("event_type <> 'error'").select("event_id", "user_id", "event_type")
        Z.run_batches(rows, "resume", handle, folder=folder)
        return t._spark.read.schema(rows.schema).parquet(*[f"{folder}/rows/{p}" for p in parts.parts()])

    return stop_and_go(t, folder, run)


@query("z03_resumed_upserts", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def z03(t):
    """The last event a user from parts that two runs wrote; the table is read from its folder."""
    folder = shared_dir(t._spark, "resumed-latest")

    def run(stream, stops):
        sink = Z.LatestTable(t._spark, folder, "user_id", "event_id", ["event_type"], fanout=3)
        write = sink.handle

        def handle(batch, number):
            write(batch, number)
            stops(number)  # after the part and its entry: the batch comes again

        sink.handle = handle
        sink.update(stream)
        return Z.LatestTable(t._spark, folder, "user_id", "event_id", ["event_type"]).read(stream.select("user_id", "event_id", "event_type").schema)

    return stop_and_go(t, folder, run)


@query("k10_upsert_sink", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def k10(t):
    return Z.latest_by_key(events(t), "user_id", "event_id", ["event_type", "value"], "latest")


@query("z04_sliding_rate", "SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2")
def z04(t):
    w = F.window("ts", "60 minutes", "30 minutes")
    counts = events(t).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    held = {}

    def keep(batch, number):
        from cairn.session import materialise

        held["last"] = materialise(batch, "rates")

    Z.run_batches(counts, "rates", keep, mode="complete")
    last = held.get("last", t._spark.createDataFrame([], counts.schema))  # no batch came
    return last.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("z07_first_lookups", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def z07(t):
    seen = events(t).dropDuplicates(["event_id"])  # no watermark: an event counts however late it comes
    return Z.run_to_table(seen.select("user_id", "event_type"), "lookups").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("z07_first_by_pair", "SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def z07_first(t):
    """The first look-up of each user and type, by state that lives for 30 days after its last change; late ones correct it."""
    rows = events(t).select(F.struct("user_id", "event_type").alias("pair"), "ts", "event_id")
    found = Z.first_seen(rows, "pair", "ts", "event_id", "first-lookups", keep="30 days")
    first = found.groupBy("key").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select("key.user_id", "key.event_type", "f.ts", "f.event_id")
