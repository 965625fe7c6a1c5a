"""Sinks (K)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.plans.registry import query
from cairn.plans.scans import chunked
from cairn.session import shared_dir
from cairn.sources import sinks


def spending(t):
    """Customers as orders would rewrite them: the balance becomes the sum of their orders."""
    totals = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("c_acctbal"))
    return totals


SPENDING = "(SELECT o_custkey AS c_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS c_acctbal FROM orders GROUP BY o_custkey)"


@query("k01_insert_with_rejects", "SELECT l_orderkey, l_linenumber, 'large' AS failed FROM lineitem WHERE l_quantity > 45 AND NOT l_discount > 0.09 UNION ALL SELECT l_orderkey, l_linenumber, 'cheap' FROM lineitem WHERE l_discount > 0.09 AND NOT l_quantity > 45 UNION ALL SELECT l_orderkey, l_linenumber, 'large,cheap' FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.09")
def k01(t):
    _, rejects = sinks.split_rejects(t.lineitem, {"large": F.col("l_quantity") <= 45, "cheap": F.col("l_discount") <= 0.09})
    return rejects.select("l_orderkey", "l_linenumber", F.array_join("failed", ",").alias("failed"))


@query("k01_failing_batches", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 AND l_quantity > 40 OR l_linenumber = 5 AND l_quantity > 45 THEN 'rejected' ELSE 'inserted' END AS outcome, CASE WHEN l_linenumber = 3 AND l_quantity > 40 OR l_linenumber = 5 AND l_quantity > 45 THEN NULL ELSE l_quantity END AS quantity FROM lineitem")
def k01_batches(t):
    """Lines whose quantity is text: some are no numbers and some are missing; the others of their batches go in."""
    text = F.when((F.col("l_linenumber") == 3) & (F.col("l_quantity") > 40), "many").when((F.col("l_linenumber") == 5) & (F.col("l_quantity") > 45), None).otherwise(F.col("l_quantity").cast("string"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", text.alias("quantity"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    target = T.StructType([T.StructField("l_orderkey", kinds["l_orderkey"]), T.StructField("l_linenumber", kinds["l_linenumber"]), T.StructField("quantity", T.DoubleType(), False)])
    inserted, rejects = sinks.insert_batches(rows, target)
    path = shared_dir(t._spark, "lines")
    inserted.write.parquet(path)
    there = t._spark.read.parquet(path).select("l_orderkey", "l_linenumber", F.lit("inserted").alias("outcome"), "quantity")
    told = rejects.filter("length(error) > 0").select(F.from_json("row", "l_orderkey long, l_linenumber int").alias("r"))
    return there.unionByName(told.select(F.col("r.l_orderkey").alias("l_orderkey"), F.col("r.l_linenumber").cast(kinds["l_linenumber"]).alias("l_linenumber"), F.lit("rejected").alias("outcome"), F.lit(None).cast("double").alias("quantity")))


@query("k02_upsert", f"SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {SPENDING}) UNION ALL SELECT c_custkey, c_acctbal FROM {SPENDING}")
def k02(t):
    return sinks.upsert(t.customer.select("c_custkey", "c_acctbal"), spending(t), ["c_custkey"])


@query("k03_insert_new", f"SELECT c_custkey, c_acctbal FROM {SPENDING} UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {SPENDING})")
def k03(t):
    return sinks.insert_new(spending(t), t.customer.select("c_custkey", "c_acctbal"), ["c_custkey"])


@query("k04_update", f"SELECT c.c_custkey, c.c_name, coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN {SPENDING} s ON c.c_custkey = s.c_custkey")
def k04(t):
    return sinks.update(t.customer.select("c_custkey", "c_name", "c_acctbal"), spending(t), ["c_custkey"], ["c_acctbal"])


@query("k05_delete_cascade", "SELECT 'orders' AS tab, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def k05(t):
    gone = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    left = sinks.delete(t.orders, {"lineitem": (t.lineitem, "l_orderkey")}, gone, "o_orderkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
    return count(left["parent"], "orders").unionByName(count(left["lineitem"], "lineitem"))


@query("k06_truncate_reload", "SELECT n_nationkey, n_name FROM nation")
def k06(t):
    spark = t.nation.sparkSession
    path = shared_dir(spark, "reload")
    t.region.selectExpr("r_regionkey AS n_nationkey", "r_name AS n_name").write.mode("overwrite").parquet(path)
    t.nation.select("n_nationkey", "n_name").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("k07_soft_delete", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 AND p_brand = 'Brand#11' THEN NULL WHEN p_size % 10 = 0 THEN '2023-01-01' WHEN p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) THEN '2024-01-01' END AS deleted_at FROM part")
def k07(t):
    """Parts of which a tenth was deleted before; those not sold in bulk go, and one brand's are restored."""
    rows = t.part.select("p_partkey", F.when(F.col("p_size") % 10 == 0, "2023-01-01").alias("deleted_at"))
    sold = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    gone = sinks.soft_delete(rows, t.part.join(sold, "p_partkey", "left_anti"), "p_partkey", F.lit("2024-01-01"))
    return sinks.restore(gone, t.part.filter("p_size % 10 = 0 AND p_brand = 'Brand#11'"), "p_partkey")


@query("k08_json_envelope", "SELECT s_suppkey, s_name, s_acctbal, (SELECT count(*) FROM supplier) AS count, 'supplier' AS source FROM supplier")
def k08(t):
    spark = t.supplier.sparkSession
    path = shared_dir(spark, "enveloped")
    sinks.write_with_envelope(t.supplier, path, source="supplier")
    head = spark.read.schema("count long, source string").json(f"{path}/metadata")
    rows = spark.read.schema(t.supplier.schema).json(f"{path}/rows").select("s_suppkey", "s_name", "s_acctbal")
    return rows.select("*", head.select("count").scalar().alias("count"), head.select("source").scalar().alias("source"))


@query("k09_lines_to_array", "SELECT c_nationkey, c_custkey, c_name FROM customer")
def k09(t):
    """Lines into JSON arrays of about 1,000 rows, several a nation, and back."""
    spark = t.customer.sparkSession
    path = shared_dir(spark, "arrays")
    rows = chunked(t.customer, "c_custkey", "c_nationkey")
    rows.groupBy("c_nationkey", "chunk").agg(F.collect_list(F.struct("c_custkey", "c_name")).alias("rows")).write.json(path)
    arrays = spark.read.schema("c_nationkey long, rows array<struct<c_custkey: long, c_name: string>>").json(path)
    return arrays.select("c_nationkey", F.explode("rows").alias("r")).select("c_nationkey", "r.c_custkey", "r.c_name")
