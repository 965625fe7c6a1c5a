"""Predicates and conditional columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any_case(column: str | Column, term: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the term act as wildcards."""
    return F.ilike(F.col(column) if isinstance(column, str) else column, F.lit(f"%{term}%"))


def any_column_contains(columns: list[str], term: str) -> Column:
    """True if one of the columns contains the term."""
    return reduce(lambda a, b: a | b, [F.coalesce(contains_any_case(c, term), F.lit(False)) for c in columns])


def first_match(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, value in rules[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def mapped(column: str | Column, table: dict[str, str], default: str | None = None) -> Column:
    """A literal dictionary look-up."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), F.col(column) if isinstance(column, str) else column)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def bucket(column: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that the number lies below, else ``last``."""
    return first_match([(column < b, label) for b, label in bounds], last)


def severity(part: Column, whole: Column, good: float = 0.8, warn: float = 0.4) -> Column:
    """good, warn or bad by the ratio of two numbers."""
    ratio = part / F.nullif(whole, F.lit(0))
    return first_match([(ratio >= good, "good"), (ratio >= warn, "warn")], "bad")


def first_truthy(*columns: str | Column) -> Column:
    """The first value that is neither null nor empty nor zero; else the last one."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*[F.when(~c.cast("string").isin("", "0", "0.0"), c) for c in cols[:-1]], cols[-1])


def missing_to_null(column: str | Column, marks: tuple[str, ...] = ("", "NA", "N/A")) -> Column:
    """Trimmed text, null for the marks of a missing value."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.when(~c.isin(*marks), c)


def blend_class(parts: Column, families: dict[str, list[str]]) -> Column:
    """Class of an array<struct<name, pct>>: a single name of 75 % or more; a family with all of
    the names, or half of the amounts; else ``blend``."""
    rules = [(F.exists(parts, lambda p: p["pct"] >= 75), "single")]
    for family, names in families.items():
        inside = (lambda names: lambda p: p["name"].isin(*names))(names)
        share = F.aggregate(F.filter(parts, inside), F.lit(0.0), lambda a, p: a + p["pct"])
        rules += [(F.forall(parts, inside), family), (share >= 50, f"{family}-based")]
    return first_match(rules, "blend")
