"""Windows (W), sorting and paging (L), deduplication (D) and set operations (U)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import dedup as D
from cairn.operators import profile as P
from cairn.plans.registry import query


@query("w01_top_per_group", "SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 8")
def w01(t):
    return P.top_n(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 8).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("w02_best_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w02(t):
    return D.first_by(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w03_first_and_last", "SELECT user_id, min(event_id) AS first_id, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def w03(t):
    return t.events.groupBy("user_id").agg(
        F.min("event_id").alias("first_id"), F.min_by("event_type", "event_id").alias("first_type"), F.max("event_id").alias("last_id"), F.max_by("event_type", "event_id").alias("last_type")
    )


@query("w04_unique_slugs", """
WITH a AS (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, replace(p_brand, '#', '') AS brand FROM part),
b AS (SELECT *, CASE WHEN p_partkey > min(p_partkey) OVER (PARTITION BY slug) THEN slug || '-' || brand ELSE slug END AS s FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS turn FROM b)
SELECT p_partkey, CASE WHEN turn > 1 THEN s || '-' || turn ELSE s END AS unique_slug FROM c""")
def w04(t):
    rows = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"))
    return D.unique_names(rows, "slug", "brand", "p_partkey").select("p_partkey", "unique_slug")


@query("w05_share_of_total", "SELECT p_partkey, round(p_size / sum(p_size) OVER (PARTITION BY p_brand), 8) AS share FROM part")
def w05(t):
    totals = t.part.groupBy("p_brand").agg(F.sum("p_size").alias("total"))  # a group's rows need not meet in one task
    return t.part.join(totals, "p_brand").select("p_partkey", F.round(F.col("p_size") / F.col("total"), 8).alias("share"))


@query("w06_trailing_rates", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n, CAST(sum(CAST(v AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS mean FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, value AS v FROM events)")
def w06(t):
    rows = t.events.withColumn("s", F.unix_timestamp("ts"))
    last = Window.partitionBy("user_id").orderBy("s", "event_id").rowsBetween(-199, 0)
    return rows.select("event_id", P.trailing_rate(rows, ["user_id"], F.col("s"), 3600).alias("n"), (F.sum(F.col("value").cast("decimal(18,4)")).over(last).cast("double") / F.count("*").over(last)).alias("mean"))


@query("w07_running_peak", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS peak FROM events")
def w07(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.events.select("event_id", F.max("value").over(w).alias("peak"))


@query("w08_batch_numbers", "SELECT o_orderkey, CAST(ceil(row_number() OVER (ORDER BY o_orderkey) / 200.0) AS BIGINT) AS batch FROM orders")
def w08(t):
    from cairn.operators.profile import positions

    return positions(t.orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", F.ceil(F.col("position") / 200).cast("long").alias("batch"))


@query("l01_page", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS FIRST, c_custkey LIMIT 50 OFFSET 100")
def l01(t):
    return t.customer.orderBy(F.desc_nulls_first(F.nullif("c_mktsegment", F.lit("BUILDING"))), "c_custkey").offset(100).limit(50).select("c_custkey", "c_name", "c_acctbal")


@query("l02_newest_facts", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def l02(t):
    who = t.orders.agg(F.min("o_custkey").alias("o_custkey"))
    mine = t.orders.join(F.broadcast(who), "o_custkey", "left_semi")
    return mine.orderBy(F.desc_nulls_first("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("l03_derived_sort", "SELECT p_name, max(length(p_name)) AS n FROM part GROUP BY p_name ORDER BY length(p_name) DESC, p_name LIMIT 25")
def l03(t):
    return t.part.groupBy("p_name").agg(F.max(F.length("p_name")).cast("long").alias("n")).orderBy(F.desc("n"), "p_name").limit(25)


@query("l04_limit", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 1000)")
def l04(t):
    return t.lineitem.limit(1000).agg(F.count("*").alias("n"))


@query("l05_single", "SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)")
def l05(t):
    last = t.nation.agg(F.max("n_name").alias("n_name"))
    return t.nation.join(last, "n_name", "left_semi").limit(2).select("n_nationkey", "n_name")


@query("d01_first_kept", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def d01(t):
    return D.first_by(t.part, ["p_name"], [F.asc("p_partkey")]).select("p_name", "p_partkey")


@query("d02_nullable_key", "SELECT event_id FROM (SELECT event_id, user_id, event_type, nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type, coalesce(k, 0) ORDER BY event_id) = 1")
def d02(t):
    rows = t.events.withColumn("k", F.nullif(F.get_json_object("props", "$.k").cast("long"), F.lit(0)))
    return D.first_by(rows, ["user_id", "event_type", F.coalesce("k", F.lit(0))], [F.asc("event_id")]).select("event_id")


@query("d03_last_wins", "SELECT o_clerk, o_orderkey FROM (SELECT CASE WHEN o_orderpriority LIKE '5%' THEN ' ' ELSE o_custkey || o_orderpriority END AS o_clerk, o_orderkey FROM orders) WHERE trim(o_clerk) <> '' QUALIFY row_number() OVER (PARTITION BY o_clerk ORDER BY o_orderkey DESC) = 1")
def d03(t):
    clerk = F.when(F.col("o_orderpriority").like("5%"), " ").otherwise(F.concat("o_custkey", "o_orderpriority"))
    return D.last_by(t.orders.select(clerk.alias("o_clerk"), "o_orderkey"), "o_clerk", "o_orderkey")


RICH = "SELECT p_name, p_partkey, p_brand, nullif(p_size % 3, 0) AS a, CASE WHEN p_type LIKE '%LARGE' THEN '' ELSE p_type END AS b FROM part"


def rich(t):
    return t.part.select("p_name", "p_partkey", "p_brand", F.nullif(F.col("p_size") % 3, F.lit(0)).alias("a"), F.when(F.col("p_type").like("%LARGE"), "").otherwise(F.col("p_type")).alias("b"))


@query("d04_richest", f"SELECT p_name, p_partkey FROM ({RICH}) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY (a IS NOT NULL)::INT + (b <> '')::INT DESC, p_partkey) = 1")
def d04(t):
    return D.richest(rich(t), "p_name", ["a", "b"], "p_partkey").select("p_name", "p_partkey")


@query("d05_richest_merged", f"SELECT p_name, p_partkey, all_p_brand FROM (SELECT p_name, p_partkey FROM ({RICH}) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY (a IS NOT NULL)::INT + (b <> '')::INT DESC, p_partkey) = 1) JOIN (SELECT p_name, string_agg(p_brand, ',' ORDER BY p_brand) AS all_p_brand FROM (SELECT DISTINCT p_name, p_brand FROM part) GROUP BY p_name) USING (p_name)")
def d05(t):
    return D.richest_merged(rich(t), "p_name", ["a", "b"], "p_partkey", "p_brand").select("p_name", "p_partkey", "all_p_brand")


@query("d06_priced_dedup", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def d06(t):
    return D.first_by(t.lineitem, ["l_partkey", "l_suppkey"], [F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("u01_union_all", "SELECT c_nationkey AS nation, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def u01(t):
    return t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind")))


@query("u02_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u02(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("u03_intersection", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def u03(t):
    return t.lineitem.select(F.col("l_partkey").alias("k")).intersect(t.part.filter("p_size > 25").select("p_partkey"))


@query("u04_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u04(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("u05_ordered_merge", "WITH a AS (SELECT p_partkey, 0 AS leg FROM part WHERE p_name ILIKE '%red%'), b AS (SELECT p_partkey, 1 AS leg FROM part WHERE p_type ILIKE '%large%') SELECT p_partkey, leg FROM a UNION ALL SELECT p_partkey, leg FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a)")
def u05(t):
    by_name = t.part.filter(F.ilike("p_name", F.lit("%red%"))).select("p_partkey", F.lit(0).alias("leg"))
    by_type = t.part.filter(F.ilike("p_type", F.lit("%large%"))).select("p_partkey", F.lit(1).alias("leg"))
    return by_name.unionByName(by_type.join(by_name, "p_partkey", "left_anti")).orderBy("leg", "p_partkey")
