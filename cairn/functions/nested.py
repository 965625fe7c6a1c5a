"""Tags, attributes, maps, blends and scores in nested values."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tag_value(tags: Column, key: str) -> Column:
    """What follows ``key:`` in the first tag that begins with it."""
    hit = F.try_element_at(F.filter(tags, lambda x: F.startswith(x, F.lit(f"{key}:"))), F.lit(1))
    return F.trim(F.substring(hit, F.lit(len(key) + 2), F.length(hit)))


def tag_values(tags: Column, key: str) -> Column:
    """All values of a key, in any case, blanks left out."""
    held = F.filter(tags, lambda x: F.startswith(F.lower(x), F.lit(f"{key.lower()}:")))
    return F.filter(F.transform(held, lambda x: F.trim(F.substring(x, F.lit(len(key) + 2), F.length(x)))), lambda x: x != "")


def last_tag_value(tags: Column, key: str) -> Column:
    return F.try_element_at(tag_values(tags, key), F.lit(-1))


def attribute(attributes: Column, name: str) -> Column:
    """The first term of the named attribute of an array<struct<name, terms>>."""
    held = F.filter(attributes, lambda a: a["name"] == name)
    return F.try_element_at(F.try_element_at(held, F.lit(1))["terms"], F.lit(1))


def without_keys(m: Column, keys: list[str]) -> Column:
    """The map without the keys; null if nothing is left."""
    left = F.map_filter(m, lambda k, v: ~k.isin(*keys))
    return F.when(F.cardinality(left) > 0, left)


def split_list(c: Column, sep: str = r"[;|]") -> Column:
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


#: What stands for an unknown blend.
NO_BLEND = r"(?i)^varies|^see below"


def blend(c: Column) -> Column:
    """array<struct<name, pct>> of ``60% A and 40% B``, ``A / B``; notes in brackets are dropped.

    Nothing comes of N/A, of texts that say that it varies or stands elsewhere, of bare numbers, and of
    names of one letter with a share or two without one.
    """
    text = F.regexp_replace(F.regexp_replace(c, r"(?i)^approximately\s+", ""), r"(?i)\s+and\s+|\s*&\s*", ", ")
    parts = split_list(F.regexp_replace(text, r"\([^)]*\)", ""), "[,/]")
    shared = r"^(\d+)%?\s+(.+)"
    read = F.transform(parts, lambda x: F.struct(F.trim(F.when(x.rlike(shared), F.regexp_extract(x, shared, 2)).otherwise(x)).alias("name"), F.when(x.rlike(shared), F.regexp_extract(x, shared, 1)).cast("double").alias("pct")))
    kept = F.filter(read, lambda x: ~x["name"].rlike(r"(?i)^see\s") & F.when(x["pct"].isNotNull(), F.char_length(x["name"]) > 1).otherwise((F.char_length(x["name"]) > 2) & ~x["name"].rlike(r"^\d")))
    return F.when((c == "N/A") | c.rlike(NO_BLEND), F.slice(kept, 1, 0)).otherwise(kept)


def composition(c: Column) -> Column:
    """array<struct<name, pct>> of every ``NN% name``; a name goes on up to the next comma."""
    pattern = r"(\d+)%\s+([^,]+)"
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("name"), F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("pct"))
    return F.transform(both, lambda x: F.struct(F.trim(x["name"]).alias("name"), x["pct"].cast("int").alias("pct")))


SCORE = re.compile(r"(\d{2,3})\s*(?:POINTS?|points?)")


def context_scores(publications: dict[str, str], reach: int = 200):
    """A column function: distinct (score, publication) pairs of 80 to 100 points in HTML.

    Tags are taken out first. The publication is the first of the given ones that stands in the
    ``reach`` characters before and after the place where the score begins.
    """
    kind = T.ArrayType(T.StructType([T.StructField("score", T.IntegerType()), T.StructField("publication", T.StringType())]))
    arrow = pa.list_(pa.struct([("score", pa.int32()), ("publication", pa.string())]))

    @F.arrow_udf(kind)
    def find(html: pa.Array) -> pa.Array:
        out = []
        for t in html.to_pylist():
            text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", t or "").replace("&amp;", "&"))
            seen: dict[tuple, None] = {}
            for m in SCORE.finditer(text):
                if 80 <= int(m[1]) <= 100:
                    near = text[max(0, m.start() - reach) : m.start() + reach].lower()
                    seen[int(m[1]), next((v for k, v in publications.items() if k in near), None)] = None
            out.append([{"score": s, "publication": p} for s, p in seen])
        return pa.array(out, arrow)

    return find


def unfence(c: Column) -> Column:
    """JSON without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def key_report(json: Column, expected: list[str]) -> Column:
    """struct(valid, missing, extra) of an object's keys."""
    keys = F.json_object_keys(json)
    wanted = F.array(*map(F.lit, expected))
    return F.struct(keys.isNotNull().alias("valid"), F.array_except(wanted, F.coalesce(keys, F.array().cast("array<string>"))).alias("missing"), F.array_except(F.coalesce(keys, F.array().cast("array<string>")), wanted).alias("extra"))


def in_vocabulary(words: Column, name: Column, vocabulary: list[str]) -> Column:
    """The first term of an ordered vocabulary found in the array, else in the name."""
    inside = [F.when(F.array_contains(words, v), F.lit(v)) for v in vocabulary]
    named = [F.when(F.contains(F.lower(name), F.lit(v.lower())), F.lit(v)) for v in vocabulary]
    return F.coalesce(*inside, *named)


#: Scores with a publication in italics, and scores with a critic alone.
WITH_PUBLICATION = r"(?i)<b>(\d+)\s*Points?\s*(?:\+\s*([^<]+))?</b>\s*–\s*(?:([^,<]+),\s*)?<em>\s*([^<]+)</em>"
WITH_CRITIC = r"(?i)<b>(\d+)\s*Points?\s*(?:\+\s*([^<]+))?</b>\s*–\s*([^<\n]+?)(?:<br|</p|$)"


def structured_scores(c: Column) -> Column:
    """array<struct<score, designation, critic, publication>> of HTML, those with a publication first.

    A score with a critic alone is left out where the same score by that critic or in a publication of that name is there.
    """
    text = F.replace(F.replace(c, F.lit("&#8211;"), F.lit("–")), F.lit("&ndash;"), F.lit("–"))
    group = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    none = lambda x: F.nullif(F.trim(x), F.lit(""))
    row = lambda score, designation, critic, publication: F.struct(score.cast("int").alias("score"), none(designation).alias("designation"), critic.alias("critic"), publication.cast("string").alias("publication"))
    first = F.transform(F.arrays_zip(*[group(WITH_PUBLICATION, g).alias(f"g{g}") for g in (1, 2, 3, 4)]), lambda x: row(x["g1"], x["g2"], none(x["g3"]), F.trim(x["g4"])))
    second = F.transform(F.arrays_zip(*[group(WITH_CRITIC, g).alias(f"g{g}") for g in (1, 2, 3)]), lambda x: row(x["g1"], x["g2"], F.regexp_replace(F.trim(x["g3"]), ",+$", ""), F.lit(None)))
    same = lambda x: lambda y: (y["score"] == x["score"]) & (y["critic"].eqNullSafe(x["critic"]) | y["publication"].eqNullSafe(x["critic"]))
    return F.aggregate(second, first, lambda found, x: F.when(F.exists(found, same(x)), found).otherwise(F.concat(found, F.array(x))))
