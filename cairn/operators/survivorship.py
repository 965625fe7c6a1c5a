"""Field merges, conflicts, grades, match-or-create and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import word_trigrams
from cairn.operators.matching import trigram_pairs
from cairn.session import materialise

#: The ranks of identity confidence, lowest first.
CONFIDENCE = ["unverified", "name_matched", "upc_matched", "lwin_matched", "verified"]


def filled(c: Column) -> Column:
    """The value, null if its text is empty."""
    return F.when(c.cast("string") != "", c)


def merge_fields(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str], protected: list[str] = ()) -> DataFrame:
    """Existing rows with fields filled from incoming ones where empty; protected only where null.

    ``conflicts`` lists the fields in which both have different values; the existing one stays.
    """
    new = incoming.select(key, *[F.col(f).alias(f"_in_{f}") for f in [*fields, *protected]])
    joined = existing.join(new, key, "left")
    out = [F.coalesce(filled(F.col(f)), filled(F.col(f"_in_{f}"))).alias(f) for f in fields]
    out += [F.coalesce(F.col(f), F.col(f"_in_{f}")).alias(f) for f in protected]
    differs = [
        F.when(filled(F.col(f)).isNotNull() & filled(F.col(f"_in_{f}")).isNotNull() & (F.col(f).cast("string") != F.col(f"_in_{f}").cast("string")), F.lit(f))
        for f in [*fields, *protected]
    ]
    conflicts = F.filter(F.array(*differs), lambda x: x.isNotNull()).alias("conflicts")
    others = [c for c in existing.columns if c not in {*fields, *protected}]
    return joined.select(*others, *out, conflicts)


def conflict_rows(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, existing, incoming) of every conflict."""
    new = incoming.select(key, *[F.col(f).cast("string").alias(f"_in_{f}") for f in fields])
    joined = existing.join(new, key)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), filled(F.col(f).cast("string")).alias("existing"), filled(F.col(f"_in_{f}")).alias("incoming")) for f in fields]))
    return joined.select(key, pairs.alias("c")).select(key, "c.*").filter("existing is not null and incoming is not null and existing <> incoming")


def higher_confidence(a: Column, b: Column) -> Column:
    """The label of higher rank; unknown ones rank lowest."""
    ranks = F.array(*map(F.lit, CONFIDENCE))
    rank = lambda c: F.coalesce(F.array_position(ranks, c), F.lit(0))
    return F.when(rank(b) > rank(a), b).otherwise(a)


def grade(facts: Column, hook: Column, vinification: Column, verified: Column) -> Column:
    """A verified, B with hook and vinification text, C with a hook, D with facts (scores, prices), F without any."""
    return F.when(verified, "A").when(hook & vinification, "B").when(hook, "C").when(facts, "D").otherwise("F")


def match_or_create(rows: DataFrame, name: str, existing: DataFrame, existing_name: str, id_col: str) -> DataFrame:
    """(name, id, created): ids of existing entities, and ids made from the name for new ones.

    New entities are made once a name, however many rows bring it.
    """
    names = rows.select(F.col(name).alias("name")).distinct()
    known = existing.groupBy(F.col(existing_name).alias("name")).agg(F.min(F.col(id_col).cast("string")).alias("known"))
    joined = names.join(known, "name", "left")
    return joined.select("name", F.coalesce("known", F.sha2("name", 256)).alias("id"), F.col("known").isNull().alias("created"))



def resolve_or_create(rows: DataFrame, name: str, seq: str, existing: DataFrame, existing_name: str, id_col: str, threshold: float = 0.4) -> DataFrame:
    """Each row with (id, tier, confidence): matched by name, else by trigrams above ``threshold``, else an entity made of it.

    What comes of it is what going row by row in the order of ``seq`` gives, in which an entity that a row makes
    is a candidate of all later rows. A name makes an entity at its first row or never, and does so if it is like no
    existing entity and like no made one that came before. That is settled in rounds: a name is decided once all
    earlier names like it are. Of several candidates the most similar one counts, then the one that was there first, then
    the least identifier. Tiers are ``exact``, ``fuzzy`` and ``created``; rows without a name have none.
    """
    row = rows.withColumn("_name", F.col(name))
    names = materialise(row.filter("_name IS NOT NULL").groupBy(F.col("_name").alias("name")).agg(F.min(seq).alias("first")), "names")
    known = materialise(existing.filter(F.col(existing_name).isNotNull()).groupBy(F.col(existing_name).alias("name")).agg(F.min(F.col(id_col).cast("string")).alias("id")), "known")
    like_known = trigram_pairs(names, known, threshold, grams=word_trigrams).filter(F.col("sim") > threshold)
    like_known = materialise(like_known.join(known.withColumnRenamed("name", "r_name"), "r_name").select(F.col("l_name").alias("name"), "sim", "id"), "like-known")
    fresh = materialise(names.join(known, "name", "left_anti").join(like_known.select("name"), "name", "left_anti"), "fresh")
    alike = trigram_pairs(names, fresh, threshold, grams=word_trigrams).filter((F.col("sim") > threshold) & (F.col("l_name") != F.col("r_name")))
    alike = materialise(alike.join(fresh.select(F.col("name").alias("r_name"), F.col("first").alias("since")), "r_name").select(F.col("l_name").alias("name"), F.col("r_name").alias("other"), "sim", "since"), "alike")
    earlier = materialise(fresh.join(alike, "name").filter(F.col("since") < F.col("first")).select("name", "other"), "earlier")

    state = materialise(fresh.select("name", "first", F.lit(None).cast("boolean").alias("makes")), "state")
    while not state.filter("makes IS NULL").isEmpty():
        open_names = state.filter("makes IS NULL")
        told = earlier.join(state.select(F.col("name").alias("other"), "makes"), "other").groupBy("name").agg(F.max(F.coalesce("makes", F.lit(False))).alias("any"), F.max(F.col("makes").isNull()).alias("open"))
        decided = open_names.drop("makes").join(told, "name", "left").select("name", "first", F.when(F.coalesce("any", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True).alias("makes"))
        state = materialise(state.filter("makes IS NOT NULL").unionByName(decided), "state")

    made = materialise(state.filter("makes").select("name", "first", F.sha2("name", 256).alias("id")), "made")
    before_all = F.lit(None).cast(names.schema["first"].dataType)
    near = like_known.select("name", "sim", before_all.alias("since"), "id")
    near = near.unionByName(alike.join(made.select(F.col("name").alias("other"), "id"), "other").select("name", "sim", "since", "id"))
    # Of the entities like a name; rows look theirs up by when they were made.
    near = near.groupBy("name").agg(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("since"), F.col("id"))).alias("near"))
    by_name = names.join(known.select("name", F.col("id").alias("known_id")), "name", "left").join(made.select("name", F.col("id").alias("made_id")), "name", "left").join(near, "name", "left")
    joined = row.join(by_name.withColumnRenamed("name", "_name"), "_name", "left")
    best = F.array_min(F.filter("near", lambda c: c["since"].isNull() | (c["since"] < F.col(seq))))
    own, fuzzy = F.coalesce("known_id", "made_id"), F.col("best")
    tier = F.when(F.col("known_id").isNotNull(), "exact").when(F.col("made_id").isNotNull(), F.when(F.col(seq) == F.col("first"), "created").otherwise("exact")).when(fuzzy.isNotNull(), "fuzzy")
    return joined.withColumn("best", best).select(*rows.columns, F.coalesce(own, fuzzy["id"]).alias("id"), tier.alias("tier"), F.when(own.isNotNull(), 1.0).otherwise(-fuzzy["far"]).alias("confidence"))
