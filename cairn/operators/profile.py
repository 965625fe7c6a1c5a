"""Profiling aggregates, top-k, medians and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialise


def top_counts(rows: DataFrame, key: str, k: int, seq: str) -> DataFrame:
    """The ``k`` most frequent values; ties in the order in which they first came."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    return counted.orderBy(F.desc("n"), "first_seq").limit(k).select(key, "n")


def fill_rates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, pct) with blanks counted as missing; percentages to one decimal."""
    filled = [F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in columns]
    one = rows.agg(F.count("*").alias("_n"), *filled)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])
    return one.select("_n", F.explode(pairs).alias("p")).select("p.column", "p.filled", F.round(100 * F.col("p.filled") / F.col("_n"), 1).alias("pct"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at place floor(n / 2) of each group's sorted values, counted from 0.

    Values are counted first, so a group's repeated values cost one row each.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = counted.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    place = F.floor(F.col("_n") / 2)
    return marked.filter((F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)).select(*keys, F.col(value).alias("median"))


def shares(rows: DataFrame, keys: list[str], member: str, amount: Column) -> DataFrame:
    """Sum by member and its share of the group's total."""
    summed = rows.groupBy(*keys, member).agg(F.sum(amount).alias("amount"))
    return summed.withColumn("share", F.col("amount") / F.sum("amount").over(Window.partitionBy(*keys)))


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def modes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least of those that tie."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias("mode"))


def histogram_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return rows.groupBy(key).agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("n_keys"))


def json_keys(rows: DataFrame, column: str, examples: int = 3) -> DataFrame:
    """Each key of JSON objects with its count and its least distinct values."""
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    # Distinct values are ranked before they are gathered, so that a key's list stays short.
    w = Window.partitionBy("k").orderBy("v")
    values = pairs.groupBy("k", "v").agg(F.count("*").alias("c"))
    ranked = values.withColumn("r", F.row_number().over(w))
    return ranked.groupBy("k").agg(F.sum("c").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("v")))), ",").alias("examples"))


def trailing_rate(rows: DataFrame, keys: list[str], seconds: Column, span: int) -> Column:
    """Rows of the trailing ``span`` seconds, by key."""
    return F.count("*").over(Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-span, 0))


def positions(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``position``, from 1, in the order of a unique key, without sorting all of them in one task.

    Rows are dealt out by ranges of the key and numbered within each; a range's first number
    follows from how many rows the ranges before it have.
    """
    parts = materialise(rows.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return parts.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("position", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
