"""Merge, survivorship and scoring (R)."""

from pyspark.sql import functions as F

from cairn.operators import profile as P
from cairn.operators import survivorship as S
from cairn.plans.matching import PRODUCT_TIERS, j23_product
from cairn.plans.registry import query
from cairn.sources import sinks

#: Two views of the customers: as registered, and as their orders tell.
EXISTING = "(SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS code FROM customer)"
INCOMING = "(SELECT o_custkey AS k, min(o_orderpriority) AS segment, 'Customer#' || o_custkey AS name, CAST(count(*) AS VARCHAR) AS code FROM orders GROUP BY o_custkey)"


def existing(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("k"), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 5 != 0, F.col("c_nationkey").cast("string")).alias("code"))


def incoming(t):
    return t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("segment"), F.concat(F.lit("Customer#"), F.first("o_custkey").cast("string")).alias("name"), F.count("*").cast("string").alias("code"))


@query("r01_additive_merge", f"SELECT e.k, coalesce(nullif(e.segment, ''), nullif(i.segment, '')) AS segment, coalesce(nullif(e.name, ''), nullif(i.name, '')) AS name FROM {EXISTING} e LEFT JOIN {INCOMING} i ON e.k = i.k")
def r01(t):
    return S.merge_fields(existing(t), incoming(t), "k", ["segment", "name"]).select("k", "segment", "name")


@query("r01_conflicts", f"SELECT k, field, a AS existing, b AS incoming FROM (SELECT e.k, unnest(['segment', 'name']) AS field, unnest([e.segment, e.name]) AS a, unnest([i.segment, i.name]) AS b FROM {EXISTING} e JOIN {INCOMING} i ON e.k = i.k) WHERE a <> '' AND b <> '' AND a <> b")
def r01_conflicts(t):
    return S.conflict_rows(existing(t), incoming(t), "k", ["segment", "name"])


@query("r02_protected", f"SELECT e.k, coalesce(e.code, i.code) AS code FROM {EXISTING} e LEFT JOIN {INCOMING} i ON e.k = i.k")
def r02(t):
    return S.merge_fields(existing(t), incoming(t), "k", ["segment"], ["code"]).select("k", "code")


@query("r03_confidence", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 5 <> 4 THEN 'upc_matched' WHEN p_size % 5 = 4 THEN 'verified' ELSE 'name_matched' END AS confidence FROM part")
def r03(t):
    a = F.when(F.col("p_size") % 5 == 4, "verified").otherwise("name_matched")
    b = F.when(F.col("p_size") % 3 == 0, "upc_matched").otherwise("unknown")
    return t.part.select("p_partkey", S.higher_confidence(a, b).alias("confidence"))


@query("r04_grades", "SELECT p_partkey, CASE WHEN p_size = 50 THEN 'A' WHEN length(p_name) > 9 AND p_size > 25 THEN 'B' WHEN length(p_name) > 9 THEN 'C' WHEN sold THEN 'D' ELSE 'F' END AS grade FROM (SELECT *, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) AS sold FROM part)")
def r04(t):
    sold = t.lineitem.filter("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("sold", F.lit(True))
    rows = t.part.join(sold, "p_partkey", "left")
    return rows.select("p_partkey", S.grade(F.coalesce("sold", F.lit(False)), F.length("p_name") > 9, F.col("p_size") > 25, F.col("p_size") == 50).alias("grade"))


@query("r05_initial_confidence", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'lwin_matched' WHEN p_size > 20 THEN 'upc_matched' ELSE 'unverified' END AS confidence FROM part")
def r05(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") > 40, "lwin_matched").when(F.col("p_size") > 20, "upc_matched").otherwise("unverified").alias("confidence"))


@query("r06_match_or_create", "SELECT name, coalesce(k, sha256(name)) AS id, k IS NULL AS created FROM (SELECT DISTINCT s_name AS name FROM supplier UNION SELECT p_name FROM part) LEFT JOIN (SELECT p_name AS name, min(CAST(p_partkey AS VARCHAR)) AS k FROM part GROUP BY p_name) USING (name)")
def r06(t):
    rows = t.supplier.select(F.col("s_name").alias("name")).unionByName(t.part.select(F.col("p_name").alias("name")))
    return S.match_or_create(rows, "name", t.part, "p_name", "p_partkey")


@query("r07_created_once", "SELECT count(*) AS n_rows, count(DISTINCT p_name) AS n_entities FROM part")
def r07(t):
    made = S.match_or_create(t.part, "p_name", t.supplier, "s_name", "s_suppkey").filter("created")
    linked = t.part.join(made, F.col("p_name") == F.col("name"))
    return linked.agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_entities"))


@query("r07_row_by_row")
def r07_rows(t):
    """Listings in the order of their keys, some misspelled, against the names that a fifth of the parts have."""
    words = F.split("p_name", " ")
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.substring("p_name", -1, 1))).when(k == 2, F.concat_ws(" ", words[1], words[0], "p_brand")).otherwise(F.concat_ws(" ", words[1], "p_type"))
    rows = t.part.select("p_partkey", name.alias("name"))
    return S.resolve_or_create(rows, "name", "p_partkey", t.part.filter("p_size % 10 = 0").select("p_name", "p_partkey"), "p_name", "p_partkey").select("p_partkey", "name", "id", "tier", F.round("confidence", 6).alias("confidence"))


@query("r08_external_ids", "SELECT 'customer' AS kind, c_custkey AS id, 'orders' AS system, CAST(n AS VARCHAR) AS value FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey UNION ALL SELECT 'customer', c_custkey, 'name', c_name FROM customer UNION ALL SELECT 'customer', c_custkey, 'orders', 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def r08(t):
    row = lambda df, system, value: df.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.lit(system).alias("system"), value.alias("value"))
    held = row(t.customer, "orders", F.lit("none")).unionByName(row(t.customer, "name", F.col("c_name")))
    new = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("string").alias("n"))
    return sinks.upsert(held, row(new, "orders", F.col("n")), ["kind", "id", "system"])


@query("r09_classification_links", "SELECT DISTINCT p_brand, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'cheap' WHEN 'LARGE' THEN 'big' END AS class FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'LARGE') AND (p_brand, CASE p_type WHEN 'LARGE' THEN 'big' ELSE 'cheap' END) NOT IN (SELECT p_brand, 'cheap' FROM part WHERE p_size = 1)")
def r09(t):
    from cairn.operators.columns import mapped

    links = t.part.select("p_brand", mapped("p_type", {"ECONOMY": "cheap", "PROMO": "cheap", "LARGE": "big"}).alias("class")).filter("class is not null").distinct()
    there = t.part.filter("p_size = 1").select("p_brand", F.lit("cheap").alias("class"))
    return links.join(there, ["p_brand", "class"], "left_anti")


@query("r10_match_audit", "SELECT tier, count(*) AS n, count(*) FILTER (confidence >= 0.9) AS accepted FROM (SELECT CASE WHEN p_size > 20 THEN 'key' ELSE 'brand' END AS tier, CASE WHEN p_size > 20 THEN 1.0 WHEN p_size > 10 THEN 0.95 ELSE 0.5 END AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY tier")
def r10(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("p_size")
    scored = rows.select(F.when(size > 20, "key").otherwise("brand").alias("tier"), F.when(size > 20, 1.0).when(size > 10, 0.95).otherwise(0.5).alias("confidence"))
    return scored.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("accepted"))


@query("r10_decisions", f"SELECT p_partkey, coalesce(tier, 'none') AS method, coalesce(confidence, 0) AS confidence, CASE WHEN confidence >= 0.9 THEN 'accepted' WHEN confidence IS NOT NULL THEN 'review' ELSE 'unmatched' END AS status FROM part LEFT JOIN ({PRODUCT_TIERS}) USING (p_partkey)")
def r10_decisions(t):
    """An audit row of each listing's match: by which tier, how sure, and whether it is taken, looked at or made anew."""
    found = t.part.select("p_partkey").join(j23_product(t), "p_partkey", "left")
    status = F.when(F.col("confidence") >= 0.9, "accepted").when(F.col("confidence").isNotNull(), "review").otherwise("unmatched")
    return found.select("p_partkey", F.coalesce("tier", F.lit("none")).alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), status.alias("status"))


@query("r11_quarantine", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 26)) AND l_shipdate >= TIMESTAMP '1997-01-01'")
def r11(t):
    bad = t.part.groupBy("p_brand").agg(F.avg("p_size").alias("m")).filter("m > 26").select("p_brand")
    parts = t.part.join(bad, "p_brand", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.filter("l_shipdate >= timestamp'1997-01-01'").join(parts, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("r12_category_resolution", "SELECT p.p_partkey, coalesce(a.v, b.v, 'generic') AS category FROM part p LEFT JOIN (SELECT p_name, p_type, min(p_brand) AS v FROM part WHERE p_size > 45 GROUP BY 1, 2) a ON p.p_name = a.p_name AND p.p_type = a.p_type LEFT JOIN (SELECT p_name, min(p_brand) AS v FROM part WHERE p_size > 48 GROUP BY 1) b ON p.p_name = b.p_name")
def r12(t):
    both = t.part.filter("p_size > 45").groupBy("p_name", "p_type").agg(F.min("p_brand").alias("a"))
    name = t.part.filter("p_size > 48").groupBy("p_name").agg(F.min("p_brand").alias("b"))
    return t.part.join(both, ["p_name", "p_type"], "left").join(name, "p_name", "left").select("p_partkey", F.coalesce("a", "b", F.lit("generic")).alias("category"))


#: Kinds of each part as a listing: a grape, a colour, and now and then the name of a blend; and the categories that are known.
KINDS = "(SELECT p_partkey, p_brand || ' ' || string_split(p_name, ' ')[2] AS grape, ['red', 'white', 'rose', NULL][p_size % 4 + 1] AS colour, CASE WHEN p_size % 7 = 0 THEN p_name || ' ' || p_type END AS blend FROM part)"
CATEGORIES = "(SELECT grape, CASE WHEN p_partkey % 2 = 0 THEN 'red' ELSE 'white' END AS colour, min(p_partkey) AS v FROM (SELECT p_partkey, p_size, p_brand || ' ' || string_split(p_name, ' ')[2] AS grape FROM part) WHERE p_size > 45 GROUP BY 1, 2)"
BLENDS = "(SELECT p_name || ' ' || p_type AS blend, min(p_partkey) AS v FROM part WHERE p_size > 47 GROUP BY 1)"


@query("r12_category_tiers", f"""
SELECT k.p_partkey, coalesce(b.v, c.v, r.v, a.v) AS v, CASE WHEN b.v IS NOT NULL THEN 'blend' WHEN c.v IS NOT NULL THEN 'grape and colour' WHEN r.v IS NOT NULL THEN 'rose as red' WHEN a.v IS NOT NULL THEN 'any colour' ELSE 'generic ' || coalesce(k.colour, 'unknown') END AS tier
FROM {KINDS} k LEFT JOIN {BLENDS} b ON k.blend = b.blend LEFT JOIN {CATEGORIES} c ON k.grape = c.grape AND k.colour = c.colour
LEFT JOIN {CATEGORIES} r ON k.grape = r.grape AND k.colour = 'rose' AND r.colour = 'red' LEFT JOIN (SELECT grape, min(v) AS v FROM {CATEGORIES} GROUP BY grape) a ON k.grape = a.grape""")
def r12_tiers(t):
    """A named blend, the grape in its colour, a rose by its red, the grape in any colour, or the generic category of the colour."""
    grape = F.concat_ws(" ", "p_brand", F.split("p_name", " ")[1])
    colours = F.array(*map(F.lit, ["red", "white", "rose"]), F.lit(None).cast("string"))
    kinds = t.part.select("p_partkey", grape.alias("grape"), F.get(colours, F.col("p_size") % 4).alias("colour"), F.when(F.col("p_size") % 7 == 0, F.concat_ws(" ", "p_name", "p_type")).alias("blend"))
    known = t.part.filter("p_size > 45").groupBy(grape.alias("grape"), F.when(F.col("p_partkey") % 2 == 0, "red").otherwise("white").alias("colour")).agg(F.min("p_partkey").alias("v"))
    blends = t.part.filter("p_size > 47").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("blend")).agg(F.min("p_partkey").alias("b"))
    reds = known.filter("colour = 'red'").select("grape", F.lit("rose").alias("colour"), F.col("v").alias("r"))
    found = kinds.join(blends, "blend", "left").join(known.withColumnRenamed("v", "c"), ["grape", "colour"], "left").join(reds, ["grape", "colour"], "left").join(known.groupBy("grape").agg(F.min("v").alias("a")), "grape", "left")
    tier = F.when(F.col("b").isNotNull(), "blend").when(F.col("c").isNotNull(), "grape and colour").when(F.col("r").isNotNull(), "rose as red").when(F.col("a").isNotNull(), "any colour").otherwise(F.concat(F.lit("generic "), F.coalesce("colour", F.lit("unknown"))))
    return found.select("p_partkey", F.coalesce("b", "c", "r", "a").alias("v"), tier.alias("tier"))


@query("r13_catch_all", "SELECT c_custkey, coalesce(n.n_name, r.catch_all) AS place FROM customer LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) n ON c_nationkey = n.n_nationkey LEFT JOIN (SELECT n_nationkey, 'any ' || r_name AS catch_all FROM nation JOIN region ON n_regionkey = r_regionkey) r ON c_nationkey = r.n_nationkey")
def r13(t):
    exact = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    wide = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("any "), "r_name").alias("catch_all"))
    return t.customer.join(exact, "c_nationkey", "left").join(wide, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", "catch_all").alias("place"))


@query("r14_context", "SELECT p_brand, string_agg(p_name || '=' || n, ',' ORDER BY n DESC, p_name) AS top_names, min(total) AS total FROM (SELECT p_brand, p_name, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand)::BIGINT AS total FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) <= 5) GROUP BY p_brand")
def r14(t):
    n = t.part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    top = P.top_n(n, ["p_brand"], [F.desc("n"), F.asc("p_name")], 5)
    gathered = top.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("rank", "p_name", "n"))).alias("v"))
    total = t.part.groupBy("p_brand").agg(F.count("*").alias("total"))
    return gathered.join(total, "p_brand").select("p_brand", F.array_join(F.transform("v", lambda x: F.concat_ws("=", x["p_name"], x["n"].cast("string"))), ",").alias("top_names"), "total")
