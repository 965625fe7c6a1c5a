"""Joins on keys, candidates, scopes and prefixes (J01-J12, J15, J27-J32)."""

from pyspark.sql import functions as F

from cairn.operators import lookups as L
from cairn.plans.registry import query


@query("j01_dimension_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def j01(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


PARTS_BY_NAME = "(SELECT p_name AS k, min(p_partkey) AS v FROM part GROUP BY p_name)"


def parts_by_name(t):
    return t.part.groupBy(F.col("p_name").alias("k")).agg(F.min("p_partkey").alias("v"))


@query("j02_candidate_lookup", f"""
WITH d AS (SELECT p_type AS k, min(p_partkey) AS v FROM part GROUP BY p_type UNION ALL SELECT k, v FROM {PARTS_BY_NAME}),
c AS (SELECT p_partkey, unnest([0, 1, 2]) AS place, unnest([p_brand, p_name, p_type]) AS k FROM part)
SELECT p_partkey, arg_min(v, place) AS v, min(place) AS place FROM c JOIN d USING (k) GROUP BY p_partkey""")
def j02(t):
    dim = parts_by_name(t).unionByName(t.part.groupBy(F.col("p_type").alias("k")).agg(F.min("p_partkey").alias("v")))
    return L.by_candidates(t.part, "p_partkey", [F.col("p_brand"), F.col("p_name"), F.col("p_type")], dim, "k", "v")


@query("j03_exact_then_normalised", "SELECT c_custkey, coalesce(a.r_regionkey, b.r_regionkey) AS r_regionkey FROM (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'ASIA' ELSE ' europe' END AS raw FROM customer) LEFT JOIN region a ON raw = a.r_name LEFT JOIN region b ON trim(lower(raw)) = lower(b.r_name)")
def j03(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "ASIA").otherwise(" europe").alias("raw"))
    exact = t.region.select(F.col("r_name").alias("raw"), F.col("r_regionkey").alias("a"))
    normal = t.region.select(F.lower("r_name").alias("key"), F.col("r_regionkey").alias("b"))
    return rows.join(exact, "raw", "left").withColumn("key", F.trim(F.lower("raw"))).join(normal, "key", "left").select("c_custkey", F.coalesce("a", "b").alias("r_regionkey"))


SUFFIXES = [" red", " green", " blue", " steel", " copper"]
#: Raw names: an alias known in code, a display, canonical or synonym name, or a name without its last word.
RAW = "(SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'the nuts' WHEN 1 THEN p_name WHEN 2 THEN upper(p_brand) WHEN 3 THEN lower(p_type) WHEN 4 THEN string_split(p_name, ' ')[1] ELSE 'unknown' END AS raw FROM part)"


@query("j04_five_levels", f"""
WITH q AS {RAW}, k AS (
 SELECT p_partkey, 0 AS level, CASE raw WHEN 'the nuts' THEN (SELECT min(p_name) FROM part) END AS key FROM q UNION ALL SELECT p_partkey, 1, raw FROM q UNION ALL SELECT p_partkey, 2, lower(raw) FROM q UNION ALL SELECT p_partkey, 3, upper(raw) FROM q
 UNION ALL SELECT p_partkey, 3 + i, raw || [{", ".join(f"'{x}'" for x in SUFFIXES)}][i] FROM q, range(1, 6) AS r(i)),
d AS (SELECT p_name AS key, p_partkey AS value, unnest([0, 1, 4, 5, 6, 7, 8]) AS level FROM part UNION ALL SELECT lower(p_brand), p_partkey, 2 FROM part UNION ALL SELECT upper(p_type), p_partkey, 3 FROM part),
m AS (SELECT p_partkey, level, min(value) AS value FROM k JOIN d USING (level, key) GROUP BY p_partkey, level)
SELECT p_partkey, b.value, b.level FROM part LEFT JOIN (SELECT p_partkey, arg_min(value, level) AS value, min(level) AS level FROM m GROUP BY p_partkey) b USING (p_partkey)""")
def j04(t):
    """Alias known in code, display name, canonical name, synonym, then the name with each of five endings."""
    kinds = [F.lit("the nuts"), F.col("p_name"), F.upper("p_brand"), F.lower("p_type"), F.split("p_name", " ")[0], F.lit("unknown")]
    raw = F.col("raw")
    rows = t.part.select("p_partkey", F.get(F.array(*kinds), F.col("p_size") % 6).alias("raw")).withColumn("first", t.part.agg(F.min("p_name")).scalar())
    dim = lambda key: t.part.select(key.alias("key"), F.col("p_partkey").alias("value"))
    display = dim(F.col("p_name"))
    levels = [(F.when(raw == "the nuts", F.col("first")), display), (raw, display), (F.lower(raw), dim(F.lower("p_brand"))), (F.upper(raw), dim(F.upper("p_type")))]
    return L.by_levels(rows, "p_partkey", levels + [(F.concat(raw, F.lit(x)), display) for x in SUFFIXES])


@query("j05_composite_key", "SELECT l_orderkey, l_linenumber, d.v FROM lineitem LEFT JOIN (SELECT l_returnflag AS f, l_linestatus AS s, min(l_orderkey) AS v FROM lineitem GROUP BY 1, 2) d ON l_returnflag = f AND l_linestatus = s")
def j05(t):
    dim = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.min("l_orderkey").alias("v"))
    return t.lineitem.join(dim, ["l_returnflag", "l_linestatus"], "left").select("l_orderkey", "l_linenumber", "v")


@query("j06_name_or_alias", "SELECT c_custkey, d.n_nationkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE replace(lower(n_name), ' ', '-') END AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) LEFT JOIN (SELECT DISTINCT n_nationkey, unnest([lower(n_name), replace(lower(n_name), ' ', '-')]) AS k FROM nation) d USING (k)")
def j06(t):
    names = F.explode(F.array_distinct(F.array(F.lower("n_name"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("-"))))).alias("k")
    dim = t.nation.select("n_nationkey", names)
    raw = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.replace(F.lower("n_name"), F.lit(" "), F.lit("-")))
    return raw.select("c_custkey", key.alias("k")).join(dim, "k", "left").select("c_custkey", "n_nationkey")


@query("j07_scoped_fallback", """
WITH d AS (SELECT p_name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS scope, p_partkey FROM part),
q AS (SELECT l_orderkey * 10 + l_linenumber AS id, p_name AS name, 'Brand#' || (l_linenumber || l_linenumber) AS want FROM lineitem JOIN part ON p_partkey = l_partkey),
u AS (SELECT DISTINCT name, want FROM q),
r AS (SELECT u.name, u.want, d.p_partkey, CASE WHEN scope = want THEN 0 WHEN scope IS NULL THEN 1 ELSE 2 END AS rank FROM u JOIN d ON u.name = d.p_name)
SELECT name || '/' || want AS id, arg_min(p_partkey, (rank, p_partkey)) AS p_partkey, min(rank) AS rank FROM r GROUP BY 1""")
def j07(t):
    dim = t.part.select("p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("scope"), "p_partkey", F.col("p_partkey").alias("seq"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("name"), F.concat(F.lit("Brand#"), "l_linenumber", "l_linenumber").alias("want")).distinct()
    rows = rows.withColumn("id", F.concat_ws("/", "name", "want"))
    return L.scoped(rows, "id", "name", "want", dim, "p_name", "scope", "p_partkey", "seq")


@query("j08_name_or_number", "SELECT s_suppkey, n.n_nationkey FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) END AS k FROM supplier) LEFT JOIN (SELECT n_nationkey, n_name AS k FROM nation UNION ALL SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation) n USING (k)")
def j08(t):
    dim = t.nation.select("n_nationkey", F.explode(F.array(F.col("n_name"), F.col("n_nationkey").cast("string"))).alias("k"))
    rows = t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    key = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string")).otherwise(F.col("n_name"))
    return rows.select("s_suppkey", key.alias("k")).join(dim, "k", "left").select("s_suppkey", "n_nationkey")


@query("j09_embedded", "SELECT o_orderkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j09(t):
    c = t.customer.select("c_custkey", F.struct("c_custkey", "c_name").alias("customer"))
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.to_json("customer").alias("customer"))


@query("j10_self_join", "SELECT a.n_nationkey, a.n_name, b.n_name AS parent FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey")
def j10(t):
    parent = t.nation.select(F.col("n_nationkey").alias("pk"), F.col("n_name").alias("parent"))
    return t.nation.join(parent, F.col("n_regionkey") == F.col("pk"), "left").select("n_nationkey", "n_name", "parent")


@query("j11_inner_embed", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def j11(t):
    c = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("j12_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j12(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_semi").select("c_custkey")


@query("j13_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j13(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").select("c_custkey")


FIRST_WORDS = "(SELECT array_to_string(string_split(p_name, ' ')[1:1], ' ') AS k, min(p_partkey) AS v FROM part GROUP BY 1 UNION ALL SELECT array_to_string(string_split(p_name, ' ')[1:2], ' '), min(p_partkey) FROM part WHERE p_size > 40 AND len(string_split(p_name, ' ')) > 1 GROUP BY 1)"


def first_words(t):
    words = F.split("p_name", " ")
    one = t.part.groupBy(words[0].alias("k")).agg(F.min("p_partkey").alias("v"))
    two = t.part.filter((F.col("p_size") > 40) & (F.size(words) > 1)).groupBy(F.concat_ws(" ", words[0], words[1]).alias("k")).agg(F.min("p_partkey").alias("v"))
    return one.unionByName(two)


@query("j15_longest_prefix", f"WITH p AS (SELECT p_partkey, p_name || ' 2019' AS name FROM part), m AS (SELECT p_partkey, name, k, v FROM p JOIN {FIRST_WORDS} d ON name = k OR starts_with(name, k || ' ') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(k) DESC) = 1) SELECT p_partkey, k, v, trim(substr(name, length(k) + 1)) AS rest FROM m")
def j15(t):
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit(" 2019")).alias("name"))
    return L.longest_prefix(rows, "p_partkey", "name", first_words(t), "k", "v")


#: Place names as a listing writes them, in the country (here the region) that it names.
PLACES = "(SELECT p_partkey, r_name AS country, [n_name, lower(n_name), n_name || ' Riserva', lower(n_name) || ' Superiore', n_name || ' di Sopra', r_name, '  ' || lower(r_name), 'Old World', 'nowhere'][p_size % 9 + 1] AS raw FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
QUALITY, DI = "(?i) (?:riserva|superiore|classico)$", "^(.+?) di .+$"


@query("j27_mapping_cascade", f"""
WITH q AS {PLACES}, x AS (SELECT *, CASE WHEN regexp_matches(raw, '{QUALITY}') THEN regexp_replace(raw, '{QUALITY}', '') END AS s, nullif(regexp_extract(raw, '{DI}', 1), '') AS di FROM q),
k AS (SELECT p_partkey, country, unnest(range(0, 9)) AS level, unnest([raw, lower(trim(raw)), s, lower(trim(s)), di, lower(trim(di)), raw, lower(trim(raw)), CASE WHEN raw = 'Old World' THEN 'EUROPE' END]) AS key FROM x),
n AS (SELECT n_name AS name, r_name AS country, n_nationkey AS v FROM nation JOIN region ON n_regionkey = r_regionkey), r AS (SELECT r_name AS name, r_name AS country, 100 + r_regionkey AS v FROM region),
d AS (SELECT unnest([0, 2, 4]) AS level, name AS key, country, v FROM n UNION ALL SELECT unnest([1, 3, 5]), lower(name), country, v FROM n UNION ALL SELECT 6, name, country, v FROM r UNION ALL SELECT 7, lower(name), country, v FROM r UNION ALL SELECT 8, name, country, v FROM r),
m AS (SELECT p_partkey, level, v FROM k JOIN d USING (level, key, country))
SELECT p_partkey, b.value, b.level FROM part LEFT JOIN (SELECT p_partkey, arg_min(v, level) AS value, min(level) AS level FROM m GROUP BY p_partkey) b USING (p_partkey)""")
def j27(t):
    """Appellation as written and normalised, without quality words, as the X of "X di Y", then region as written, normalised and by hand."""
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    n, r = F.col("n_name"), F.col("r_name")
    kinds = [n, F.lower(n), F.concat(n, F.lit(" Riserva")), F.concat(F.lower(n), F.lit(" Superiore")), F.concat(n, F.lit(" di Sopra")), r, F.concat(F.lit("  "), F.lower(r)), F.lit("Old World"), F.lit("nowhere")]
    rows = t.part.join(nations, F.col("p_partkey") % 25 == F.col("n_nationkey")).select("p_partkey", r.alias("country"), F.get(F.array(*kinds), F.col("p_size") % 9).alias("raw"))
    raw = F.col("raw")
    stripped = F.when(raw.rlike(QUALITY), F.regexp_replace(raw, QUALITY, ""))
    base = F.nullif(F.regexp_extract(raw, DI, 1), F.lit(""))
    plain = lambda c: F.lower(F.trim(c))
    within = lambda c: F.concat(c, F.lit("|"), F.col("country"))  # noqa: E731 - null where the name is
    dim = lambda df, key, value: df.select(F.concat(key, F.lit("|"), "r_name").alias("key"), value.cast("long").alias("value"))
    place, place_plain = dim(nations, n, F.col("n_nationkey")), dim(nations, F.lower(n), F.col("n_nationkey"))
    region, region_plain = dim(t.region, r, 100 + F.col("r_regionkey")), dim(t.region, F.lower(r), 100 + F.col("r_regionkey"))
    levels = [(c, d) for name in (raw, stripped, base) for c, d in ((within(name), place), (within(plain(name)), place_plain))]
    levels += [(within(raw), region), (within(plain(raw)), region_plain), (within(F.when(raw == "Old World", "EUROPE")), region)]
    return t.part.select("p_partkey").join(L.by_levels(rows, "p_partkey", levels), "p_partkey", "left")


@query("j28_shortened_prefix", f"SELECT p_partkey, k, v FROM (SELECT p_partkey, p_name AS name FROM part) JOIN {FIRST_WORDS} d ON name = k OR starts_with(name, k || ' ') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(k) DESC) = 1")
def j28(t):
    return L.longest_prefix(t.part, "p_partkey", "p_name", first_words(t), "k", "v").select("p_partkey", "k", "v")


@query("j29_longest_suffix", """
WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS name, string_split(p_name, ' ')[-1] || ' ' || p_type AS two, p_type FROM part),
d AS (SELECT DISTINCT p_type AS key, 'metal' AS value, 1 AS level FROM p UNION ALL SELECT DISTINCT two, 'finish', 0 FROM p WHERE p_type <> 'PROMO' AND two NOT LIKE '%g %')
SELECT p_partkey, key, level, value FROM p JOIN d ON name = key OR ends_with(name, ' ' || key) WHERE key <> 'ECONOMY' QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC, level) = 1""")
def j29(t):
    """Names lose their first words until the rest is known: to a word of the name and the type, or to the type."""
    last = F.element_at(F.split("p_name", " "), -1)
    two = F.concat_ws(" ", last, "p_type")
    metals = t.part.select(F.col("p_type").alias("k"), F.lit("metal").alias("v")).distinct()
    finishes = t.part.filter((F.col("p_type") != "PROMO") & ~two.like("%g %")).select(two.alias("k"), F.lit("finish").alias("v")).distinct()
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return L.longest_suffix(rows, "p_partkey", "name", [(finishes, "k", "v"), (metals, "k", "v")], excluded=["ECONOMY"])


@query("j30_outer_key_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS sold, b.n AS listed FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) a FULL JOIN (SELECT p_partkey AS k, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1) b ON a.k = b.k")
def j30(t):
    a = t.lineitem.filter("l_quantity > 40").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("sold"))
    b = t.part.filter("p_size > 10").groupBy(F.col("p_partkey").alias("k")).agg(F.count("*").alias("listed"))
    return a.join(b, "k", "full")


@query("j32_two_parents", "SELECT a.p_partkey, b.p_name AS parent1, c.p_name AS parent2 FROM part a LEFT JOIN part b ON a.p_partkey = 2 * b.p_partkey LEFT JOIN part c ON a.p_size = c.p_partkey")
def j32(t):
    one = t.part.select((2 * F.col("p_partkey")).alias("k1"), F.col("p_name").alias("parent1"))
    two = t.part.select(F.col("p_partkey").alias("k2"), F.col("p_name").alias("parent2"))
    return t.part.join(one, F.col("p_partkey") == F.col("k1"), "left").join(two, F.col("p_size") == F.col("k2"), "left").select("p_partkey", "parent1", "parent2")
