"""Validation issues, orphans and table reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, severity, rule) of every rule whose condition a row meets."""
    marked = F.array(*[F.when(condition, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, condition in rules])
    return rows.select(key, F.explode(F.filter(marked, lambda x: x.isNotNull())).alias("i")).select(key, "i.*")


def orphans(references: DataFrame, kind: str, ref: str, targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Polymorphic references (kind, ref) whose target is missing."""
    parts = [references.filter(F.col(kind) == k).join(df.select(F.col(c).alias(ref)), ref, "left_anti").select(kind, ref) for k, (df, c) in targets.items()]
    return reduce(DataFrame.unionByName, parts)


def table_counts(sections: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """(section, name, n) of tables, with totals where the name, or both, are null."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("section"), F.lit(name).alias("name"), "n") for s, tables in sections.items() for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).rollup("section", "name").agg(F.sum("n").alias("n"))


#: The kinds that documents may name, and the least and greatest score of each scale.
PRODUCER_TYPES = ["estate", "negociant", "cooperative", "virtual", "corporate"]
COLOURS = ["red", "white", "rose", "orange"]
WINE_TYPES = ["table", "sparkling", "dessert", "fortified", "aromatized"]
EFFERVESCENCE = ["still", "sparkling", "semi_sparkling"]
SCALES = {"100": (50, 100), "20": (10, 20), "5": (1, 5)}


def document_issues(docs: DataFrame, key: str) -> DataFrame:
    """(key, severity, rule, wine, year) of nested documents: a producer, its wines, their grapes and vintages, and scores.

    ``docs`` has ``producer`` (name, country, producer_type) and ``wines`` (name, color, wine_type, effervescence, grapes of name
    and grape, vintages of year, abv, rs_g_l and scores of publication, score and scale). A score's scale is 100 where none of 20 and 5 is named.
    """
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    given = lambda c: ~blank(c)
    none = F.lit(None)

    def found(rules, wine=none, year=none):
        """The rules that fire, as an array of issues."""
        issue = lambda severity, rule: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), wine.cast("string").alias("wine"), year.cast("int").alias("year"))
        return F.filter(F.array(*[F.when(F.coalesce(fires, F.lit(False)), issue(severity, rule)) for severity, rule, fires in rules]), lambda x: x.isNotNull())

    each = lambda array, f: F.flatten(F.coalesce(F.transform(array, f), F.array().cast("array<array<struct<severity:string,rule:string,wine:string,year:int>>>")))

    def of_score(wine, year):
        def run(s):
            named = s["scale"].isin(*[k for k in SCALES if k != "100"])
            low, high = ([F.when(named & (s["scale"] == k), v[i]) for k, v in SCALES.items() if k != "100"] for i in (0, 1))
            outside = (s["score"] < F.coalesce(*low, F.lit(SCALES["100"][0]))) | (s["score"] > F.coalesce(*high, F.lit(SCALES["100"][1])))
            return found([("ERROR", "score without publication", blank(s["publication"])), ("WARN", "unusual score", (s["score"] != 0) & outside)], wine, year)

        return run

    def of_vintage(wine):
        def run(v):
            own = found([("WARN", "vintage without year", v["year"].isNull()), ("WARN", "unusual abv", (v["abv"] != 0) & ((v["abv"] < 0) | (v["abv"] > 25))), ("WARN", "very high residual sugar", v["rs_g_l"] > 500)], wine, v["year"])
            return F.concat(own, each(v["scores"], of_score(wine, v["year"])))

        return run

    def of_wine(w):
        name = F.when(blank(w["name"]), "(unnamed)").otherwise(w["name"])
        still = w["wine_type"] == "still"
        own = found(
            [
                ("CRITICAL", "wine without name", blank(w["name"])),
                ("ERROR", "colour", given(w["color"]) & ~w["color"].isin(*COLOURS)),
                ("WARN", "wine type still", still),
                ("ERROR", "wine type", ~still & given(w["wine_type"]) & ~w["wine_type"].isin(*WINE_TYPES)),
                ("ERROR", "effervescence", given(w["effervescence"]) & ~w["effervescence"].isin(*EFFERVESCENCE)),
            ],
            name,
        )
        grapes = each(w["grapes"], lambda g: found([("ERROR", "grape without name", blank(g["name"]) & blank(g["grape"]))], name))
        return F.concat(own, grapes, each(w["vintages"], of_vintage(name)))

    p = F.col("producer")
    own = found([("CRITICAL", "producer without name", blank(p["name"])), ("CRITICAL", "producer without country", blank(p["country"])), ("ERROR", "producer type", given(p["producer_type"]) & ~p["producer_type"].isin(*PRODUCER_TYPES))])
    return docs.select(key, F.explode(F.concat(own, each(F.col("wines"), of_wine))).alias("i")).select(key, "i.*")
