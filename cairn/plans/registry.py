"""The queries of the catalogue engine and their SQL.

Modules of this package register their queries with :func:`query`; ``queries()`` and
``oracle_sql()`` import them all.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import arrow_batches, table

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["scans", "sinks", "predicates", "aggregates", "windows", "lookups", "matching", "text", "numbers", "nested", "graphs", "geometry", "survivorship", "validation", "reads", "streams"]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder by name: ``t.nation``; steps in Python get them in bounded batches."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        arrow_batches(spark, 2048)  # rows can hold long texts

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``, with its DuckDB SQL if there is any."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"cairn.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation with their balance, largest first."""
    t = Tables(spark, sf_dir)
    totals = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    return (
        totals.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "n_customers", "balance")
        .orderBy(F.desc("n_customers"), "n_name")
    )
