"""The browser's read path: search over several entities with paging and counts."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import snippet
from cairn.operators.columns import contains_any_case
from cairn.plans.registry import query


def search(entities: dict[str, tuple[DataFrame, str, str]], term: str, limit: int = 10) -> DataFrame:
    """(kind, id, name, total): the first hits by name of each entity with the exact number of hits."""
    parts = []
    for kind, (df, key, name) in entities.items():
        hits = df.filter(contains_any_case(name, term)).select(F.col(key).cast("string").alias("id"), F.col(name).alias("name"))
        total = hits.agg(F.count("*").alias("total"))
        page = hits.orderBy("name", F.col("id").cast("long")).limit(limit)
        parts.append(page.select(F.lit(kind).alias("kind"), "id", "name", total.scalar().alias("total")))
    return reduce(DataFrame.unionByName, parts)


@query("q01_search_entities", "SELECT * FROM (SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, count(*) OVER () AS total FROM part WHERE p_name ILIKE '%red%' ORDER BY p_name, p_partkey LIMIT 10) UNION ALL SELECT * FROM (SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, count(*) OVER () FROM supplier WHERE s_name ILIKE '%1%' ORDER BY s_name, s_suppkey LIMIT 10)")
def q01(t):
    return search({"part": (t.part, "p_partkey", "p_name")}, "red").unionByName(search({"supplier": (t.supplier, "s_suppkey", "s_name")}, "1"))


@query("q02_list_with_counts", "SELECT n_nationkey, n_name, r_name, n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey ORDER BY n_name LIMIT 20")
def q02(t):
    n = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(n, "n_nationkey", "left")
    return rows.orderBy("n_name").limit(20).select("n_nationkey", "n_name", "r_name", "n")


@query("q03_search_text", "SELECT doc_id, CASE WHEN p > 41 THEN '...' ELSE '' END || substr(text, greatest(p - 40, 1), p + 7 + 80 - greatest(p - 40, 1)) || CASE WHEN p + 7 + 80 - 1 < length(text) THEN '...' ELSE '' END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'thering') AS p FROM documents) WHERE p > 0")
def q03(t):
    return t.documents.select("doc_id", snippet("text", "thering").alias("snippet")).filter("snippet is not null")
