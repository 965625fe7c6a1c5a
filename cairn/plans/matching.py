"""Fuzzy and tiered matching (J14, J16-J26, J31)."""

from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.operators import matching as M
from cairn.plans.registry import query
from cairn.plans.text import TRIGRAMS, WORD_TRIGRAMS

SIM = "(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"
#: Names as another source writes them: the last letter doubled.
OTHER = "(SELECT DISTINCT p_brand, p_name || right(p_name, 1) AS name FROM part)"
NAMES = "(SELECT DISTINCT p_brand, p_name AS name FROM part)"


def other(t):
    return t.part.select("p_brand", F.concat("p_name", F.substring("p_name", -1, 1)).alias("name")).distinct()


def names(t):
    return t.part.select("p_brand", F.col("p_name").alias("name")).distinct()


@query("j16_substring_in_block", f"SELECT p_brand, a.name AS l_name, min(b.name) AS r_name FROM {OTHER} a JOIN {NAMES} b USING (p_brand) WHERE contains(a.name, b.name) OR contains(b.name, a.name) GROUP BY 1, 2")
def j16(t):
    return M.contained_pairs(other(t), names(t), "p_brand").groupBy("p_brand", "l_name").agg(F.min("r_name").alias("r_name"))


def pairs_sql(block, TRIGRAMS=TRIGRAMS):
    on = "a.p_brand = b.p_brand" if block else "true"
    return f"(SELECT {'a.p_brand,' if block else ''} a.name AS l_name, b.name AS r_name, {SIM.format(a='ag', b='bg')} AS sim FROM (SELECT DISTINCT {'p_brand,' if block else ''} name, {TRIGRAMS.format(c='name')} AS ag FROM {OTHER}) a JOIN (SELECT DISTINCT {'p_brand,' if block else ''} name, {TRIGRAMS.format(c='name')} AS bg FROM {NAMES}) b ON {on})"


@query("j17_trigram_in_block", f"SELECT p_brand, l_name, r_name, round(sim, 6) AS sim FROM {pairs_sql(True)} WHERE sim >= 0.4 QUALIFY row_number() OVER (PARTITION BY p_brand, l_name ORDER BY sim DESC, r_name) = 1")
def j17(t):
    pairs = M.trigram_pairs(other(t), names(t), 0.4, "p_brand").withColumn("key", F.struct("p_brand", "l_name"))
    return M.best_match(pairs, "key", [F.desc("sim"), F.asc("r_name")]).select("p_brand", "l_name", "r_name", F.round("sim", 6).alias("sim"))


@query("j18_trigram_best", f"SELECT l_name, r_name, round(sim, 6) AS sim FROM {pairs_sql(False, WORD_TRIGRAMS)} WHERE sim > 0.4 QUALIFY row_number() OVER (PARTITION BY l_name ORDER BY sim DESC, r_name) = 1")
def j18(t):
    pairs = M.trigram_pairs(other(t).select("name"), names(t).select("name"), 0.4, grams=N.word_trigrams).filter("sim > 0.4")
    return M.best_match(pairs, "l_name", [F.desc("sim"), F.asc("r_name")]).select("l_name", "r_name", F.round("sim", 6).alias("sim"))


@query("j19_trigram_threshold", f"SELECT p_brand, l_name, r_name, round(sim, 6) AS sim FROM {pairs_sql(True, WORD_TRIGRAMS)} WHERE sim >= 0.5")
def j19(t):
    return M.trigram_pairs(other(t), names(t), 0.5, "p_brand", N.word_trigrams).select("p_brand", "l_name", "r_name", F.round("sim", 6).alias("sim"))


LIMIT = "greatest(CAST(floor(0.4 * length(a.name)) AS BIGINT), 5)"
EDITS = f"(SELECT a.name AS l_name, b.name AS r_name, CAST(levenshtein(a.name, b.name) AS BIGINT) AS distance FROM (SELECT DISTINCT name FROM {OTHER}) a, (SELECT DISTINCT name FROM {NAMES}) b WHERE levenshtein(a.name, b.name) <= {LIMIT})"


def edits(t):
    limit = F.greatest(F.floor(0.4 * F.length("l_name")), F.lit(5))
    return M.edit_pairs(other(t).select("name"), names(t).select("name"), limit).withColumn("distance", F.col("distance").cast("long"))


@query("j20_edit_top3", f"SELECT l_name, r_name, distance, row_number() OVER (PARTITION BY l_name ORDER BY distance, r_name) AS rank FROM {EDITS} QUALIFY rank <= 3")
def j20(t):
    from cairn.operators.profile import top_n

    return top_n(edits(t), ["l_name"], [F.asc("distance"), F.asc("r_name")], 3).withColumn("rank", F.col("rank").cast("long"))


@query("j21_edit_best", f"SELECT p_brand, a.name AS l_name, arg_min(b.name, (levenshtein(a.name, b.name), b.name)) AS r_name FROM {OTHER} a JOIN {NAMES} b USING (p_brand) GROUP BY 1, 2")
def j21(t):
    return M.nearest_by_edits(other(t), names(t), "p_brand")


#: Listings: part names as they are, shortened, or misspelled, by the order that lists them; and names that no part has.
LISTED = "(SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[1] ELSE p_name || right(p_name, 1) END AS name FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT s_name FROM supplier)"


def listed(t):
    rows = t.lineitem.select("l_partkey", (F.col("l_linenumber") % 3).alias("k")).distinct().join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("k") == 0, F.col("p_name")).when(F.col("k") == 1, F.split("p_name", " ")[0]).otherwise(F.concat("p_name", F.substring("p_name", -1, 1)))
    return rows.select(name.alias("name")).unionByName(t.supplier.select(F.col("s_name").alias("name"))).distinct()


CANON = "(SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name)"
ALIAS = "(SELECT string_split(p_name, ' ')[1] AS name, min(p_partkey) AS id FROM part GROUP BY 1)"


def canon(t):
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


def aliases(t):
    return t.part.groupBy(F.split("p_name", " ")[0].alias("name")).agg(F.min("p_partkey").alias("id"))


def three_tiers(t, confident: float = 0.9, threshold: float = 0.4):
    """Exact, then alias, then the best trigram match of what neither tier has."""
    rows = listed(t)
    exact = rows.join(canon(t), "name").withColumn("seq", F.col("id"))
    alias = rows.join(exact.select("name"), "name", "left_anti").join(aliases(t), "name").withColumn("seq", F.col("id"))
    rest = rows.join(exact.select("name").unionByName(alias.select("name")), "name", "left_anti")
    fuzzy = M.trigram_pairs(rest, canon(t).select("name"), threshold, grams=N.word_trigrams).filter(F.col("sim") > threshold)
    fuzzy = fuzzy.join(canon(t).withColumnRenamed("name", "r_name"), "r_name").select(F.col("l_name").alias("name"), "id", "sim", F.col("id").alias("seq"))
    return rows, [(exact, "exact", F.lit(1.0)), (alias, "alias", F.lit(confident)), (fuzzy, "fuzzy", F.col("sim"))]


TIERS = f"""
WITH q AS (SELECT * FROM {LISTED}), c AS (SELECT * FROM {CANON}), al AS (SELECT * FROM {ALIAS}),
m AS (SELECT q.name, c.id, 0 AS n, 'exact' AS tier, 1.0 AS confidence FROM q JOIN c USING (name)
 UNION ALL SELECT q.name, al.id, 1, 'alias', 0.9 FROM q JOIN al USING (name)
 UNION ALL SELECT name, id, 2, 'fuzzy', sim FROM (SELECT q.name, c.id, {SIM.format(a='qg', b='cg')} AS sim FROM (SELECT name, {WORD_TRIGRAMS.format(c='name')} AS qg FROM q) q, (SELECT id, {WORD_TRIGRAMS.format(c='name')} AS cg FROM c) c) WHERE sim > 0.4),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY n, confidence DESC, id) = 1)
"""


@query("j22_three_tiers", TIERS + "SELECT name, id, tier, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM b")
def j22(t):
    _, parts = three_tiers(t)
    return M.tiers(parts, "name", "id").withColumn("confidence", F.round("confidence", 6))


@query("j23_key_tiers", "SELECT l_orderkey, l_linenumber, CASE WHEN a.p_partkey IS NOT NULL THEN 'key' WHEN b.p_brand IS NOT NULL THEN 'brand' END AS tier, CASE WHEN a.p_partkey IS NOT NULL THEN 1.0 WHEN b.p_brand IS NOT NULL THEN 0.95 END::DOUBLE AS confidence FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 20) a ON l_partkey = a.p_partkey LEFT JOIN (SELECT DISTINCT p_brand FROM part) b ON b.p_brand = 'Brand#' || l_linenumber || l_linenumber")
def j23(t):
    by_key = t.part.filter("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("k"))
    brands = t.part.select("p_brand").distinct().withColumn("b", F.lit(True))
    rows = t.lineitem.withColumn("p_brand", F.concat(F.lit("Brand#"), "l_linenumber", "l_linenumber")).join(by_key, "l_partkey", "left").join(brands, "p_brand", "left")
    return rows.select("l_orderkey", "l_linenumber", F.when(F.col("k"), "key").when(F.col("b"), "brand").alias("tier"), F.when(F.col("k"), 1.0).when(F.col("b"), 0.95).alias("confidence"))


#: Listings of a producer (here a brand) with a code now and then, and the products that are known.
OFFERS = "(SELECT p_partkey, p_brand, CASE WHEN p_size > 30 THEN p_partkey * 7 END AS code, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] || 's' ELSE lower(p_type) END AS name FROM part)"
PRODUCTS = "(SELECT p_brand, p_name AS name, min(p_partkey) AS id FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2)"


PRODUCT_TIERS = f"""
WITH q AS (SELECT *, {WORD_TRIGRAMS.format(c='name')} AS g FROM {OFFERS}), k AS (SELECT p_partkey * 7 AS code, p_partkey AS id FROM part WHERE p_size > 40), d AS (SELECT *, {WORD_TRIGRAMS.format(c='name')} AS g FROM {PRODUCTS}),
m AS (SELECT p_partkey, k.id, 0 AS n, 1.0 AS confidence FROM q JOIN k USING (code) UNION ALL SELECT p_partkey, d.id, 1, 0.95 FROM q JOIN d ON q.p_brand = d.p_brand AND q.name = d.name
 UNION ALL SELECT p_partkey, id, 2, sim FROM (SELECT q.p_partkey, d.id, {SIM.format(a='q.g', b='d.g')} AS sim FROM q JOIN d ON q.p_brand = d.p_brand) WHERE sim > 0.4)
SELECT p_partkey, id, ['key', 'exact', 'fuzzy'][n + 1] AS tier, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n, confidence DESC, id) = 1"""


@query("j23_product_tiers", PRODUCT_TIERS)
def j23_product(t):
    """A product by its code, by its name within the producer, or by the most similar name within the producer."""
    k, w = F.col("p_size") % 3, F.split("p_name", " ")
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(w[1], F.lit(" "), w[0], F.lit("s"))).otherwise(F.lower("p_type"))
    rows = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 30, F.col("p_partkey") * 7).alias("code"), name.alias("name"))
    known = t.part.filter("p_size % 2 = 0").groupBy("p_brand", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    codes = t.part.filter("p_size > 40").select((F.col("p_partkey") * 7).alias("code"), F.col("p_partkey").alias("id"))
    by_code = rows.join(codes, "code").select("p_partkey", "id", F.col("id").alias("seq"))
    exact = rows.join(known, ["p_brand", "name"]).select("p_partkey", "id", F.col("id").alias("seq"))
    like = M.trigram_pairs(rows, known, 0.4, "p_brand", N.word_trigrams).filter("sim > 0.4").join(known.withColumnRenamed("name", "r_name"), ["p_brand", "r_name"])
    fuzzy = rows.join(like.withColumnRenamed("l_name", "name"), ["p_brand", "name"]).select("p_partkey", "id", F.col("id").alias("seq"), "sim")
    found = M.tiers([(by_code, "key", F.lit(1.0)), (exact, "exact", F.lit(0.95)), (fuzzy, "fuzzy", F.col("sim"))], "p_partkey", "id")
    return found.withColumn("confidence", F.round("confidence", 6))


@query("j24_scoped_promotion", "SELECT s_suppkey, arg_min(c_custkey, (CASE WHEN c_nationkey = s_nationkey THEN 0 ELSE 1 END, c_custkey)) AS c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey // 15 GROUP BY s_suppkey")
def j24(t):
    a = t.supplier.withColumn("k", F.col("s_suppkey"))
    b = t.customer.withColumn("k", F.floor(F.col("c_custkey") / 15))
    scope = F.when(F.col("c_nationkey") == F.col("s_nationkey"), 0).otherwise(1)
    return a.join(b, "k").groupBy("s_suppkey").agg(F.min_by("c_custkey", F.struct(scope, F.col("c_custkey"))).alias("c_custkey"))


#: Names as producers have them and as listings write them; countries are brands, one listing in three names none.
STRIP = " (?:" + "|".join(N.SUFFIXES) + ")$"
PRODUCERS = "(SELECT CASE p_size % 4 WHEN 0 THEN p_name || ' estate' WHEN 1 THEN p_name || ' ' || lower(p_type) ELSE p_name END AS name, p_brand AS country, min(p_partkey) AS id FROM part GROUP BY 1, 2)"
LISTINGS = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' winery' WHEN 2 THEN p_name || ' ' || lower(p_type) || ' cellars' WHEN 3 THEN string_split(p_name, ' ')[1] || ' wines' ELSE p_name || ' ' || lower(p_type) || ' alias' END AS name, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS country FROM part)"


def listings(t):
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.lower("p_type")
    written = F.when(k % 5 == 0, name).when(k % 5 == 1, F.concat(name, F.lit(" winery"))).when(k % 5 == 2, F.concat_ws(" ", name, kind, F.lit("cellars"))).when(k % 5 == 3, F.concat(F.split(name, " ")[0], F.lit(" wines"))).otherwise(F.concat_ws(" ", name, kind, F.lit("alias")))
    return t.part.select("p_partkey", written.alias("name"), F.when(k % 3 > 0, F.col("p_brand")).alias("country"))


def producers(t):
    k, name = F.col("p_size") % 4, F.col("p_name")
    written = F.when(k == 0, F.concat(name, F.lit(" estate"))).when(k == 1, F.concat_ws(" ", name, F.lower("p_type"))).otherwise(name)
    return t.part.groupBy(written.alias("name"), F.col("p_brand").alias("country")).agg(F.min("p_partkey").alias("id"))


@query("j25_four_way_cascade", f"""
WITH q AS (SELECT *, regexp_replace(name, '{STRIP}', '') AS s FROM {LISTINGS}), c AS (SELECT *, regexp_replace(name, '{STRIP}', '') AS s FROM {PRODUCERS}),
al AS (SELECT p_name || ' ' || lower(p_type) || ' alias' AS name, min(p_partkey) AS id FROM part WHERE p_size > 25 GROUP BY 1 UNION ALL SELECT string_split(p_name, ' ')[1], min(p_partkey) FROM part GROUP BY 1),
m AS (SELECT p_partkey, c.id, 0 AS n, q.country = c.country AS here FROM q JOIN c ON q.name = c.name
 UNION ALL SELECT p_partkey, al.id, 1, false FROM q JOIN al ON q.name = al.name
 UNION ALL SELECT p_partkey, c.id, 2, q.country = c.country FROM q JOIN c ON q.s = c.name WHERE q.s <> q.name AND length(q.s) > 2
 UNION ALL SELECT p_partkey, al.id, 3, false FROM q JOIN al ON q.s = al.name WHERE q.s <> q.name AND length(q.s) > 2
 UNION ALL SELECT p_partkey, c.id, 4, q.country = c.country FROM q JOIN c ON c.s <> c.name AND q.name = c.s
 UNION ALL SELECT p_partkey, c.id, 5, q.country = c.country FROM q JOIN c ON c.s <> c.name AND q.s = c.s)
SELECT p_partkey, arg_min(id, (n, CASE WHEN here THEN 0 ELSE 1 END, id)) AS id, ['exact', 'alias', 'suffix', 'suffix_alias', 'reverse', 'reverse'][min(n) + 1] AS tier FROM m GROUP BY p_partkey""")
def j25(t):
    """By name, by alias, without a suffix to either, and by names that lose their own suffix; the country named comes first."""
    strip = lambda c: F.regexp_replace(c, STRIP, "")
    alias = t.part.filter("p_size > 25").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("alias")).alias("name")).agg(F.min("p_partkey").alias("id"))
    alias = alias.unionByName(t.part.groupBy(F.split("p_name", " ")[0].alias("name")).agg(F.min("p_partkey").alias("id"))).withColumn("country", F.lit(None).cast("string"))
    return M.name_cascade(listings(t), "p_partkey", producers(t), alias, strip)


@query("j26_confidence_label", f"SELECT p_partkey, CASE WHEN l = r THEN 'exact' WHEN contains(l, r) OR contains(r, l) THEN 'substring' WHEN regexp_replace(l, '{STRIP}', '') = regexp_replace(r, '{STRIP}', '') THEN 'suffix_stripped' ELSE 'slug_match' END AS label FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' winery' WHEN 2 THEN p_name || ' cellars' WHEN 3 THEN p_name || ' family' ELSE lower(p_type) END AS l, CASE p_size % 5 WHEN 2 THEN p_name || ' estate' WHEN 3 THEN p_name || ' gmbh' ELSE p_name END AS r FROM part)")
def j26(t):
    """A listing's name and the producer's to which its page led: equal, one in the other, equal without suffixes, or by the page alone."""
    k, name = F.col("p_size") % 5, F.col("p_name")
    put = lambda word: F.concat(name, F.lit(f" {word}"))
    rows = t.part.select("p_partkey", F.when(k == 0, name).when(k == 1, put("winery")).when(k == 2, put("cellars")).when(k == 3, put("family")).otherwise(F.lower("p_type")).alias("l"), F.when(k == 2, put("estate")).when(k == 3, put("gmbh")).otherwise(name).alias("r"))
    a, b = N.normalise("l"), N.normalise("r")
    strip = lambda c: F.regexp_replace(c, STRIP, "")
    label = F.when(a == b, "exact").when(F.contains(a, b) | F.contains(b, a), "substring").when(strip(a) == strip(b), "suffix_stripped").otherwise("slug_match")
    return rows.select("p_partkey", label.alias("label"))


#: Producers: names that stand in one or more countries (here brands), some of them deleted, and listings that name a country.
MAKERS = "(SELECT p_name AS name, p_brand AS country, min(p_partkey) AS id, bool_and(p_size > 40) AS deleted FROM part GROUP BY 1, 2)"


@query("j22_exact_in_scope", f"""
WITH q AS (SELECT DISTINCT p_name AS name, p_brand AS country FROM part UNION SELECT DISTINCT p_name, NULL FROM part UNION SELECT DISTINCT p_name, 'Brand#99' FROM part), m AS (SELECT * FROM {MAKERS} WHERE NOT deleted),
al AS (SELECT string_split(name, ' ')[1] || ' alias' AS name, arg_min(id, id) AS id, arg_min(deleted, id) AS deleted FROM {MAKERS} GROUP BY 1), qq AS (SELECT * FROM q UNION SELECT name, NULL FROM al),
e AS (SELECT qq.name, qq.country, arg_min(m.id, (CASE WHEN m.country = qq.country THEN 0 ELSE 1 END, m.id)) AS id, 'exact' AS tier FROM qq JOIN m ON qq.name = m.name GROUP BY 1, 2)
SELECT * FROM e UNION ALL SELECT qq.name, qq.country, al.id, 'alias' FROM qq JOIN al ON qq.name = al.name WHERE NOT al.deleted AND NOT EXISTS (SELECT 1 FROM e WHERE e.name = qq.name)""")
def j22_scope(t):
    """Exact names prefer the country that the listing names; deleted producers do not match, nor do aliases of them."""
    makers = t.part.groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("maker_country")).agg(F.min("p_partkey").alias("id"), F.every(F.col("p_size") > 40).alias("deleted"))
    alias = makers.groupBy(F.concat(F.split("name", " ")[0], F.lit(" alias")).alias("name")).agg(F.min("id").alias("id"), F.min_by("deleted", "id").alias("deleted"))
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    none = F.lit(None).cast("string").alias("country")
    rows = t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("country")).unionByName(names.select("name", none)).unionByName(names.select("name", F.lit("Brand#99").alias("country"))).unionByName(alias.select("name", none)).distinct()
    same = F.when(F.col("country") == F.col("maker_country"), 0).otherwise(1)
    exact = rows.join(makers.filter("not deleted"), "name").groupBy("name", "country").agg(F.min_by("id", F.struct(same, F.col("id"))).alias("id"), F.lit("exact").alias("tier"))
    by_alias = rows.join(exact.select("name"), "name", "left_anti").join(alias.filter("not deleted"), "name").select("name", "country", "id", F.lit("alias").alias("tier"))
    return exact.unionByName(by_alias)


@query("j22_unmatched", TIERS + "SELECT q.name FROM q LEFT JOIN b USING (name) WHERE b.name IS NULL")
def unmatched(t):
    rows, parts = three_tiers(t)
    return rows.join(M.tiers(parts, "name", "id").select("name"), "name", "left_anti")
