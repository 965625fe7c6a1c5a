"""Projection, predicates and conditional columns (P)."""

from pyspark.sql import functions as F

from cairn.operators import columns as C
from cairn.plans.registry import query


@query("p01_adapters", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, 'supplier' FROM supplier")
def p01(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


@query("p02_null_filters", "SELECT count(*) FILTER (k IS NULL) AS n_null, count(*) FILTER (k IS NOT NULL) AS n_set FROM (SELECT nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)")
def p02(t):
    k = t.events.select(F.nullif(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))
    return k.agg(F.count_if(F.col("k").isNull()).alias("n_null"), F.count_if(F.col("k").isNotNull()).alias("n_set"))


@query("p03_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p03(t):
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("p04_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def p04(t):
    d = F.col("l_shipdate")
    return t.lineitem.filter((d >= "1997-01-01") & (d < "1998-01-01") & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).select("l_orderkey", "l_linenumber")


@query("p05_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def p05(t):
    return t.part.filter(C.contains_any_case("p_name", "red")).select("p_partkey", "p_name")


@query("p06_any_column", "SELECT p_partkey FROM part WHERE p_name ILIKE '%st%' OR p_brand ILIKE '%st%' OR p_type ILIKE '%st%'")
def p06(t):
    return t.part.filter(C.any_column_contains(["p_name", "p_brand", "p_type"], "st")).select("p_partkey")


@query("p07_skip_rules", "SELECT page_id FROM pages WHERE NOT (regexp_matches(url, '#') OR regexp_matches(url, '[?&]page=') OR regexp_matches(lower(url), '^https?://m\\.'))")
def p07(t):
    skip = [F.col("url").rlike("#"), F.col("url").rlike("[?&]page="), F.col("url").rlike(r"(?i)^https?://m\.")]
    return t.pages.filter(~(skip[0] | skip[1] | skip[2])).select("page_id")


@query("p08_category_filter", "SELECT page_id, CASE WHEN html ILIKE '%script%' AND url ILIKE '%ref=%' THEN false WHEN url ILIKE '%/en/%' THEN true WHEN html ILIKE '%lang=\"fr\"%' THEN true ELSE false END AS wanted FROM pages")
def p08(t):
    deny = C.contains_any_case("html", "script") & C.contains_any_case("url", "ref=")
    wanted = C.first_match([(deny, False), (C.contains_any_case("url", "/en/"), True), (C.contains_any_case("html", 'lang="fr"'), True)], False)
    return t.pages.select("page_id", wanted.alias("wanted"))


@query("p09_array_any", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 6)) > 0 AND p_name NOT LIKE '%green%'")
def p09(t):
    long_word = F.exists(F.split("p_name", " "), lambda w: F.length(w) >= 6)
    return t.part.filter(long_word & ~F.col("p_name").contains("green")).select("p_partkey")


@query("p10_case_pairs", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'rushed' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority LIKE '5%' THEN 'slow' ELSE 'open' END AS state FROM orders")
def p10(t):
    done, priority = F.col("o_orderstatus") == "F", F.col("o_orderpriority")
    return t.orders.select("o_orderkey", C.first_match([(done & priority.like("1%"), "rushed"), (done, "done"), (priority.like("5%"), "slow")], "open").alias("state"))


@query("p11_dictionary", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS code FROM customer")
def p11(t):
    return t.customer.select("c_custkey", C.mapped("c_mktsegment", {"BUILDING": "b", "MACHINERY": "m"}, "other").alias("code"))


@query("p12_buckets", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part")
def p12(t):
    return t.part.select("p_partkey", C.bucket(F.col("p_size"), [(10, "small"), (30, "medium")], "large").alias("size"))


@query("p13_severity", "SELECT c_nationkey, CASE WHEN n_pos / n >= 0.95 THEN 'good' WHEN n_pos / n >= 0.85 THEN 'warn' ELSE 'bad' END AS band FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_pos FROM customer GROUP BY c_nationkey)")
def p13(t):
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_pos"))
    return g.select("c_nationkey", C.severity(F.col("n_pos"), F.col("n"), 0.95, 0.85).alias("band"))


@query("p14_blend_class", """
SELECT o_custkey, CASE WHEN list_max(pct) >= 75 THEN 'single' WHEN len(list_filter(names, lambda n: n NOT IN ('1-URGENT', '2-HIGH'))) = 0 THEN 'fast'
  WHEN list_sum(list_transform(range(1, len(names) + 1), lambda i: CASE WHEN names[i] IN ('1-URGENT', '2-HIGH') THEN pct[i] ELSE 0 END)) >= 50 THEN 'fast-based' ELSE 'blend' END AS kind
FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderpriority) AS names, list(100.0 * n / total ORDER BY o_orderpriority) AS pct
      FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS total FROM orders GROUP BY 1, 2) GROUP BY o_custkey)""")
def p14(t):
    n = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    parts = n.groupBy("o_custkey").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), F.col("n")))).alias("p"))
    shares = F.transform("p", lambda x: F.struct(x["name"].alias("name"), (100.0 * x["n"] / F.col("total")).alias("pct")))
    return parts.withColumn("parts", shares).select("o_custkey", C.blend_class(F.col("parts"), {"fast": ["1-URGENT", "2-HIGH"]}).alias("kind"))


@query("p15_falsy_coalesce", "SELECT event_id, coalesce(nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), user_id) AS v FROM events")
def p15(t):
    return t.events.select("event_id", C.first_truthy(F.get_json_object("props", "$.k").cast("long"), "user_id").alias("v"))


@query("p16_missing_marks", "SELECT o_orderkey, CASE WHEN trim(o_orderstatus) NOT IN ('', 'O') THEN trim(o_orderstatus) END AS status FROM orders")
def p16(t):
    return t.orders.select("o_orderkey", C.missing_to_null("o_orderstatus", ("", "O")).alias("status"))


@query("p17_class_with_exclusion", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') AND NOT contains(p_name, 'bolt') THEN 'steel' WHEN contains(p_name, 'bolt') THEN 'brass' END AS metal FROM part")
def p17(t):
    k = F.col("p_name")
    return t.part.select("p_partkey", C.first_match([(k.contains("red") & ~k.contains("bolt"), "steel"), (k.contains("bolt"), "brass")]).alias("metal"))


@query("p18_regex_rules", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.org/') THEN 'org' WHEN regexp_matches(url, '\\.net/') THEN 'net' ELSE 'other' END AS domain FROM pages")
def p18(t):
    return t.pages.select("page_id", C.first_match([(F.col("url").rlike(r"\.org/"), "org"), (F.col("url").rlike(r"\.net/"), "net")], "other").alias("domain"))
