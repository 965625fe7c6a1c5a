"""Validation and reports (X)."""

from pyspark.sql import functions as F

from cairn.operators import validation as V
from cairn.plans.registry import query
from cairn.sources import sinks


@query("x01_import_issues", "SELECT l_orderkey * 10 + l_linenumber AS id, unnest(list_filter([CASE WHEN l_returnflag = 'R' THEN 'CRITICAL' END, CASE WHEN l_linestatus NOT IN ('O') THEN 'ERROR' END, CASE WHEN l_tax > 0.07 THEN 'WARN' END], lambda x: x IS NOT NULL)) AS severity FROM lineitem")
def x01(t):
    rows = t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rules = [("CRITICAL", "returned", F.col("l_returnflag") == "R"), ("ERROR", "status", ~F.col("l_linestatus").isin("O")), ("WARN", "tax", F.col("l_tax") > 0.07)]
    return V.issues(rows, "id", rules).select("id", "severity")


@query("x01_documents", """
WITH l AS (SELECT l_orderkey AS o_orderkey, 'L' || l_linenumber AS wine, CASE WHEN l_quantity <> 50 THEN 2000 + l_linenumber END AS year, * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN ('CRITICAL|producer without name') END, CASE WHEN o_orderpriority = '5-LOW' THEN 'CRITICAL|producer without country' END, CASE WHEN o_orderstatus = 'O' THEN 'ERROR|producer type' END], lambda x: x IS NOT NULL)) AS issue, NULL AS wine, NULL AS year FROM orders
UNION ALL SELECT o_orderkey, unnest(list_filter([CASE WHEN l_returnflag = 'A' THEN 'ERROR|colour' END, CASE WHEN l_linestatus = 'O' THEN 'WARN|wine type still' END, CASE WHEN l_tax > 0.07 THEN 'ERROR|effervescence' END, CASE WHEN l_discount > 0.09 THEN 'ERROR|grape without name' END], lambda x: x IS NOT NULL)), wine, NULL FROM l
UNION ALL SELECT o_orderkey, unnest(list_filter([CASE WHEN l_quantity = 50 THEN 'WARN|vintage without year' END, CASE WHEN l_quantity > 25 THEN 'WARN|unusual abv' END, CASE WHEN l_extendedprice > 50000 THEN 'WARN|very high residual sugar' END,
 CASE WHEN l_linenumber = 4 THEN 'ERROR|score without publication' END, CASE WHEN CASE WHEN l_linenumber % 3 = 0 THEN l_quantity < 10 OR l_quantity > 20 WHEN l_linenumber % 3 = 1 THEN l_quantity < 1 OR l_quantity > 5 ELSE l_quantity < 50 END THEN 'WARN|unusual score' END], lambda x: x IS NOT NULL)), wine, year FROM l""")
def x01_documents(t):
    """Orders as documents of producers, their lines as wines with grapes, vintages and scores."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    text = F.lit(None).cast("string")
    score = F.struct(F.when(n != 4, "Paper").alias("publication"), q.alias("score"), F.when(n % 3 == 0, "20").when(n % 3 == 1, "5").alias("scale"))
    vintage = F.struct(F.when(q != 50, 2000 + n).cast("int").alias("year"), q.alias("abv"), (F.col("l_extendedprice") / 100).alias("rs_g_l"), F.array(score).alias("scores"))
    grape = F.struct(text.alias("name"), F.when(F.col("l_discount") <= 0.09, "grape").alias("grape"))
    colour = F.when(F.col("l_returnflag") == "A", "rosé").when(F.col("l_returnflag") == "R", "red").otherwise("")
    wine = F.struct(F.concat(F.lit("L"), n.cast("string")).alias("name"), colour.alias("color"), F.when(F.col("l_linestatus") == "O", "still").otherwise("table").alias("wine_type"), F.when(F.col("l_tax") > 0.07, "fizzy").alias("effervescence"), F.array(grape).alias("grapes"), F.array(vintage).alias("vintages"))
    wines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(wine).alias("wines"))  # the lines of one order
    status = F.col("o_orderstatus")
    producer = F.struct(F.when(status != "P", F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderpriority") != "5-LOW", "FR").otherwise("").alias("country"), F.when(status == "F", "estate").when(status == "O", "castle").alias("producer_type"))
    docs = t.orders.join(wines, "o_orderkey", "left").select("o_orderkey", producer.alias("producer"), "wines")
    return V.document_issues(docs, "o_orderkey").select("o_orderkey", F.concat_ws("|", "severity", "rule").alias("issue"), "wine", "year")


@query("x02_row_rejects", "SELECT count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM (SELECT c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD' AS ok FROM customer)")
def x02(t):
    good, bad = sinks.split_rejects(t.customer, {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "HOUSEHOLD"})
    marked = good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok")))
    return marked.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query("x03_orphans", "SELECT 'customer' AS kind, c_custkey * 2 AS ref FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'supplier', s_suppkey * 3 FROM supplier WHERE s_suppkey * 3 NOT IN (SELECT s_suppkey FROM supplier)")
def x03(t):
    refs = t.customer.select(F.lit("customer").alias("kind"), (F.col("c_custkey") * 2).alias("ref")).unionByName(t.supplier.select(F.lit("supplier").alias("kind"), (F.col("s_suppkey") * 3).alias("ref")))
    return V.orphans(refs, "kind", "ref", {"customer": (t.customer, "c_custkey"), "supplier": (t.supplier, "s_suppkey")})


@query("x04_table_counts", "SELECT section, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'people' AS section, 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'people', 'supplier', count(*) FROM supplier UNION ALL SELECT 'sales', 'orders', count(*) FROM orders UNION ALL SELECT 'sales', 'lineitem', count(*) FROM lineitem) GROUP BY ROLLUP (section, name)")
def x04(t):
    return V.table_counts({"people": {"customer": t.customer, "supplier": t.supplier}, "sales": {"orders": t.orders, "lineitem": t.lineitem}})


@query("x05_stuck_on_default", "SELECT n_name, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS stuck FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def x05(t):
    g = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("stuck"))
    return g.join(t.nation, "n_nationkey").select("n_name", "n", "stuck")
