"""Deduplication, unique names and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.profile import positions
from cairn.session import materialise


def first_by(rows: DataFrame, keys: list[str | Column], seq: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*seq)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def last_by(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key that is not blank."""
    kept = rows.filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return first_by(kept, [key], [F.desc(seq)])


def filled_fields(columns: list[str]) -> Column:
    """How many of the columns are neither null nor empty."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns])


def richest(rows: DataFrame, key: str, columns: list[str], seq: str) -> DataFrame:
    """Of each key the row with most filled fields; the earliest of those that tie."""
    return first_by(rows, [key], [F.desc(filled_fields(columns)), F.asc(seq)])


def richest_merged(rows: DataFrame, key: str, columns: list[str], seq: str, gathered: str) -> DataFrame:
    """The richest row of each key with the union of the key's values of ``gathered``."""
    union = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(gathered)), ",").alias(f"all_{gathered}"))
    return richest(rows, key, columns, seq).join(union, key)


def unique_names(rows: DataFrame, slug: str, qualifier: str, seq: str) -> DataFrame:
    """Distinct ``unique_slug``: the first row of a slug keeps it, later ones take the qualifier; whoever finds
    a name taken by a row before it counts on, -2, -3 and so on, until one is free.

    ``seq`` is unique and tells the order. Rows of one name are numbered by ranges, not in one task, and try the
    names of their numbers. Where rows of different names meet, the earlier one keeps the name and the other one and
    those that follow it count on; rounds end when all names differ, which is what going row by row gives.
    """
    firsts = rows.groupBy(slug).agg(F.min(seq).alias("_first"))
    named = rows.join(firsts, slug).withColumn("_base", F.when(F.col(seq) == F.col("_first"), F.col(slug)).otherwise(F.concat_ws("-", slug, qualifier))).drop("_first")
    placed = positions(named.withColumn("_key", F.struct("_base", seq)), "_key").drop("_key")
    starts = placed.groupBy("_base").agg(F.min("position").alias("_start"))
    placed = materialise(placed.join(starts, "_base").withColumn("_turn", F.col("position") - F.col("_start") + 1).drop("position", "_start"), "turns")
    bumps = None
    while True:
        if bumps is None:
            tried = placed.withColumn("_at", F.col("_turn"))
        else:
            own = bumps.groupBy("_base").agg(F.collect_list(F.struct("_from", "_by")).alias("_bumps"))
            passed = F.array_max(F.transform(F.filter("_bumps", lambda b: b["_from"] <= F.col("_turn")), lambda b: b["_by"]))
            tried = placed.join(own, "_base", "left").withColumn("_at", F.col("_turn") + F.coalesce(passed, F.lit(0))).drop("_bumps")
        tried = tried.withColumn("unique_slug", F.when(F.col("_at") > 1, F.concat_ws("-", "_base", "_at")).otherwise(F.col("_base")))
        met = tried.groupBy("unique_slug").agg(F.min(seq).alias("_winner"), F.count("*").alias("_n")).filter("_n > 1")
        lost = materialise(tried.join(met, "unique_slug").filter(F.col(seq) != F.col("_winner")).select("_base", F.col("_turn").alias("_from"), (F.col("_at") + 1 - F.col("_turn")).alias("_by")), "bumps")
        if lost.isEmpty():
            return tried.drop("_base", "_turn", "_at")
        # Of a name's bumps only those count that lie above all before them; a row's last one replaces its earlier ones.
        bumps = materialise((lost if bumps is None else bumps.unionByName(lost)).groupBy("_base", "_from").agg(F.max("_by").alias("_by")), "bumps")
