"""Aggregations (A)."""

from pyspark.sql import functions as F

from cairn.operators import profile as P
from cairn.plans.registry import query

MONEY = "decimal(18,2)"


def exact(column):
    """Sums of cents without rounding."""
    return F.sum(F.col(column).cast(MONEY)).cast("double")


@query("a01_top_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, min(p_partkey) LIMIT 10")
def a01(t):
    return P.top_counts(t.part, "p_type", 10, "p_partkey")


@query("a02_fill_rates", "SELECT 'status' AS \"column\", count(*) FILTER (o_orderstatus <> 'O') AS filled, round(100.0 * count(*) FILTER (o_orderstatus <> 'O') / count(*), 1) AS pct FROM orders UNION ALL SELECT 'priority', count(o_orderpriority), 100.0 FROM orders")
def a02(t):
    rows = t.orders.select(F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return P.fill_rates(rows, ["status", "priority"])


@query("a03_distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a03(t):
    return t.lineitem.agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("a04_min_max", "SELECT p_brand, min(p_size) AS low, max(p_size) AS high, min(p_retailprice) AS cheap, max(p_retailprice) AS dear FROM part GROUP BY p_brand")
def a04(t):
    return t.part.groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.min("p_retailprice").alias("cheap"), F.max("p_retailprice").alias("dear"))


@query("a05_upper_median", "SELECT l_returnflag, quantity_mean, list_sort(v)[CAST(floor(len(v) / 2) AS BIGINT) + 1] AS median FROM (SELECT l_returnflag, round(avg(l_quantity), 4) AS quantity_mean, list(l_quantity) AS v FROM lineitem GROUP BY l_returnflag)")
def a05(t):
    mean = t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("quantity_mean"))
    return P.upper_median(t.lineitem, ["l_returnflag"], "l_quantity").join(mean, "l_returnflag")


@query("a06_shares", "SELECT c_nationkey, c_mktsegment, n, round(share, 6) AS share FROM (SELECT c_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS share FROM customer GROUP BY 1, 2) WHERE share >= 0.15 AND n >= 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) <= 3")
def a06(t):
    s = P.shares(t.customer, ["c_nationkey"], "c_mktsegment", F.lit(1)).filter("share >= 0.15 AND amount >= 2")
    return P.top_n(s, ["c_nationkey"], [F.desc("amount"), F.asc("c_mktsegment")], 3).select("c_nationkey", "c_mktsegment", F.col("amount").alias("n"), F.round("share", 6).alias("share"))


@query("a07_two_levels", "SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name, c_mktsegment), (r_name, c_mktsegment))")
def a07(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupingSets([["r_name", "n_name", "c_mktsegment"], ["r_name", "c_mktsegment"]], "r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("a08_modes", "SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS mode FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def a08(t):
    return P.modes(t.orders, ["o_custkey"], "o_orderpriority")


@query("a09_collect", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def a09(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query("a10_json_keys", "SELECT 'k' AS k, count(*) AS n, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT json_extract_string(props, '$.k') AS v FROM events ORDER BY v LIMIT 3)) AS examples FROM events")
def a10(t):
    return P.json_keys(t.events, "props")


@query("a11_duplicates", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def a11(t):
    return t.part.groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


@query("a12_dashboard", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(DISTINCT o_custkey) FROM orders) AS with_orders, (SELECT count(*) FROM orders) AS orders, (SELECT round(count(*) / count(DISTINCT l_orderkey), 4) FROM lineitem) AS lines_per_order")
def a12(t):
    orders = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    per_customer = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").agg(F.count("*").alias("customers"), F.count("n").alias("with_orders"), F.sum("n").alias("orders"))
    lines = t.lineitem.agg(F.round(F.count("*") / F.countDistinct("l_orderkey"), 4).alias("lines_per_order"))
    return per_customer.withColumn("lines_per_order", lines.scalar())


@query("a13_fact_counts", "SELECT n_nationkey, n_name, n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey")
def a13(t):
    n = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.nation.join(n, "n_nationkey", "left").select("n_nationkey", "n_name", "n")


@query("a14_mean_position", "SELECT c_mktsegment, round(avg(c_nationkey * 3.5 - 45), 6) AS lat, round(avg(c_nationkey * 7.0 - 90), 6) AS lng FROM customer GROUP BY c_mktsegment")
def a14(t):
    k = F.col("c_nationkey").cast("double")
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg(k * 3.5 - 45), 6).alias("lat"), F.round(F.avg(k * 7 - 90), 6).alias("lng"))


@query("a15_cached_aggregates", "SELECT l_partkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(DISTINCT l_suppkey) AS merchants FROM lineitem WHERE l_discount <= 0.05 GROUP BY l_partkey")
def a15(t):
    return t.lineitem.filter("l_discount <= 0.05").groupBy("l_partkey").agg(F.count("*").alias("n"), exact("l_extendedprice").alias("total"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.countDistinct("l_suppkey").alias("merchants"))


@query("a16_count_histogram", "SELECT rows_per_key, count(*) AS n_keys FROM (SELECT count(*) AS rows_per_key FROM orders GROUP BY o_custkey) GROUP BY rows_per_key")
def a16(t):
    return P.histogram_of_counts(t.orders, "o_custkey")


@query("a17_popularity", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) AS n_first FROM events GROUP BY user_id")
def a17(t):
    least = t.events.agg(F.min("event_type").alias("least"))
    rows = t.events.withColumn("least", least.scalar())
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == F.col("least")).alias("n_first"))


@query("a18_grand_total", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a18(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), exact("l_quantity").alias("quantity"))


@query("a19_nested_groups", "SELECT r_name, string_agg(n_name || ':' || n, ';' ORDER BY n_name) AS members FROM (SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) GROUP BY r_name")
def a19(t):
    n = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = n.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    parts = F.array_sort(F.collect_list(F.struct("n_name", "n")))
    return rows.groupBy("r_name").agg(F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["n_name"], x["n"].cast("string"))), ";").alias("members"))


@query("a20_descriptor_rollup", "SELECT p_brand, p_type, CAST(sum(n) AS BIGINT) AS frequency FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey GROUP BY p_brand, p_type")
def a20(t):
    n = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.part.join(n, "p_partkey").groupBy("p_brand", "p_type").agg(F.sum("n").alias("frequency"))
