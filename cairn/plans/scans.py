"""Scans (S)."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.plans.registry import query
from cairn.session import shared_dir
from cairn.sources import files, workbooks

NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("s01_scan_filter", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def s01(t):
    return t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_acctbal")


def chunked(rows, key, *by, size=1000):
    """Rows with ``chunk``, which cuts each group of ``by`` into parts of about ``size`` rows."""
    sizes = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("chunks"))
    joined = rows.join(sizes, list(by)) if by else rows.withColumn("chunks", sizes.scalar())
    return joined.withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks"))).drop("chunks")


@query("s02_json_envelope", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s02(t):
    """Documents ``{"items": [...]}`` of about 1,000 rows, one a file."""
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    path = shared_dir(rows.sparkSession, "envelope")
    envelopes = chunked(rows, "c_custkey").groupBy("chunk").agg(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("items"))
    envelopes.select("items").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_envelope(rows.sparkSession, path, "items", rows.schema)


@query("s03_json_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s03(t):
    path = shared_dir(t.events.sparkSession, "lines")
    good = t.events.select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("value"))
    broken = t.events.select(F.concat(F.lit('{"event_id": '), "event_id").alias("value"))
    good.unionByName(broken).write.text(path)
    return files.read_lines(t.events.sparkSession, path, "event_id long, k long")


@query("s04_keyed_last_line", "SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def s04(t):
    return t.events.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("s05_csv_scan", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size >= 25) AND p_name <> ''")
def s05(t):
    path = shared_dir(t.part.sparkSession, "csv")
    t.part.select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit('", x')).alias("p_name"), "p_type", "p_size").write.option("header", True).option("escape", '"').csv(path)
    rows = files.read_delimited(t.part.sparkSession, path, "p_partkey long, p_name string, p_type string, p_size int")
    kinds = rows.filter("p_size >= 25").select("p_type").distinct()
    return rows.join(kinds, "p_type", "left_semi").select("p_partkey", F.regexp_extract("p_name", '^"(.*)", x$', 1).alias("p_name"), "p_type").filter("p_name <> ''")


@F.arrow_udf(T.BinaryType())
def _workbook(sheet: pa.Array, ids: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array([workbooks.build_workbook({s: [["id", "name", None], *([str(i), n, "x"] for i, n in zip(a, b, strict=True))]}) for s, a, b in zip(sheet.to_pylist(), ids.to_pylist(), names.to_pylist(), strict=True)], pa.binary())


@query("s06_workbooks", "SELECT r_name AS sheet, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'x' AS third FROM nation JOIN region ON n_regionkey = r_regionkey")
def s06(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("v"))
    books = rows.select("r_name", _workbook("r_name", "v.n_nationkey", "v.n_name").alias("content"))
    cells = books.select("r_name", F.explode(workbooks.workbook_rows("content")).alias("r")).select("r_name", "r.*")
    record = workbooks.with_headers(cells, F.col("r_name"))
    return record.select("sheet", F.col("record")["id"].alias("id"), F.col("record")["name"].alias("name"), F.col("record")["col_2"].alias("third"))


@query("s07_sheets", "SELECT r_name AS sheet, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def s07(t):
    spark = t.nation.sparkSession
    root = shared_dir(spark, "sheets")
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows.write.option("header", True).partitionBy("r_name").csv(root)
    names = [r["r_name"] for r in t.region.select("r_name").collect()]  # the sheets of one workbook
    paths = {n: f"{root}/r_name={n.replace(' ', '%20')}" for n in names if " " not in n} | {n: f"{root}/r_name={n}" for n in names if " " in n}
    return files.read_sheets(spark, paths, "n_nationkey int, n_name string", skip=("ASIA",))


@query("s08_pipe_delimited", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s08(t):
    path = shared_dir(t.supplier.sparkSession, "pipe")
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).option("sep", "|").csv(path)
    return files.read_delimited(t.supplier.sparkSession, path, "s_suppkey long, s_name string, s_acctbal double", sep="|")


@query("s13_features", "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, 'Point' AS geometry_type, CAST(s_nationkey AS DOUBLE) AS lng, CAST(s_nationkey * 2 AS DOUBLE) AS lat FROM supplier")
def s13(t):
    spark = t.supplier.sparkSession
    path = shared_dir(spark, "features")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col("s_nationkey").cast("double"), (F.col("s_nationkey") * 2).cast("double")).alias("coordinates")).alias("geometry"),
    )
    collections = chunked(t.supplier, "s_suppkey", "s_nationkey").groupBy("s_nationkey", "chunk").agg(F.collect_list(feature).alias("features"))
    collections.select("features").write.option("maxRecordsPerFile", 1).json(path)
    found = files.read_features(spark, path, T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]), T.ArrayType(T.DoubleType()))
    return found.select("id", "name", "geometry_type", F.col("coordinates")[0].alias("lng"), F.col("coordinates")[1].alias("lat"))


@query("s15_folder_walk")
def s15(t):
    return files.list_files(t.nation.sparkSession, t._dir, "*.parquet").select("name", "bytes")


@query("s16_slices", "SELECT n_name AS member, kind FROM nation, (VALUES ('BUILDING'), ('MACHINERY')) AS k(kind) UNION ALL SELECT 'other', kind FROM (VALUES ('BUILDING'), ('MACHINERY')) AS k(kind)")
def s16(t):
    return files.slices(t.nation, "n_name", ["BUILDING", "MACHINERY"])


@query("s17_json_in_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s17(t):
    outer = t.events.select("event_id", F.to_json(F.struct(F.concat(F.lit("x = ["), "props", F.lit("];")).alias("body"))).alias("raw"))
    inner = F.regexp_extract(F.get_json_object("raw", "$.body"), r"(\[.*\])", 1)
    return outer.select("event_id", F.explode(F.from_json(inner, "array<struct<k: long>>")).alias("r")).select("event_id", "r.k")


@query("s18_counts", "SELECT count(*) AS n_rows FROM lineitem")
def s18(t):
    return t.lineitem.agg(F.count("*").alias("n_rows"))


#: Columns of the tables, and those that refer to another table's key.
TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
REFERENCES = {"nation": [("n_regionkey", "region", "r_regionkey")], "customer": [("c_nationkey", "nation", "n_nationkey")], "supplier": [("s_nationkey", "nation", "n_nationkey")], "orders": [("o_custkey", "customer", "c_custkey")], "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")], "labels": [("doc_id", "documents", "doc_id")]}
#: Names of types in either engine.
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "array<float>": "FLOAT[]"}


@query("s19_schema", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_columns, (SELECT count(*) FROM {n}) AS n_rows FROM (DESCRIBE {n})" for n in TABLE_NAMES))
def s19(t):
    out = None
    for name in TABLE_NAMES:
        df = getattr(t, name)
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("s19_references", " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, '{other}' AS refers_to, (SELECT count(*) FROM {n}) AS n_rows, (SELECT count(*) FROM {n} WHERE {c} NOT IN (SELECT {k} FROM {other})) AS dangling FROM (SELECT 1)" for n, refs in REFERENCES.items() for c, other, k in refs))
def s19_references(t):
    """Foreign keys with the rows that have one and those whose key is missing; nulls dangle not."""
    out = None
    for name, refs in REFERENCES.items():
        df = getattr(t, name)
        for column, other, key in refs:
            known = getattr(t, other).select(F.col(key).alias(column)).distinct().withColumn("_there", F.lit(True))
            found = df.select(column).join(known, column, "left").agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).isNotNull() & F.col("_there").isNull()).alias("dangling"))
            row = found.select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit(other).alias("refers_to"), "n_rows", "dangling")
            out = row if out is None else out.unionByName(row)
    return out


@query("s19_columns", " UNION ALL ".join(f"SELECT '{n}' AS table_name, column_name, column_type AS kind FROM (DESCRIBE {n})" for n in TABLE_NAMES))
def s19_columns(t):
    """Columns and types of all tables, from the files' schemas."""
    rows = [(name, f.name, KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())) for name in TABLE_NAMES for f in getattr(t, name).schema.fields]
    return t._spark.createDataFrame(rows, "table_name string, column_name string, kind string")  # as many rows as columns


ARTICLE = "(?s)<article>(.*?)</article>"


@query("s12_html_pages", rf"""
SELECT page_id, nullif(regexp_extract(html, '<html[^>]* lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title,
 nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '') AS heading, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS links,
 CAST(len(regexp_extract_all(regexp_extract(html, '{ARTICLE}', 1), '(?s)<p>(.*?)</p>', 1)) AS BIGINT) AS paragraphs,
 sha256(trim(regexp_replace(regexp_replace(regexp_extract(html, '{ARTICLE}', 1), '<[^>]+>', ' ', 'g'), ' +', ' ', 'g'))) AS body
FROM pages""")
def s12(t):
    """Records from pages by what marks their fields: attributes, elements, links and the article's text."""
    one = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    article = F.regexp_extract("html", ARTICLE, 1)
    return t.pages.select(
        "page_id",
        one('<html[^>]* lang="([a-z]+)"').alias("lang"),
        one("(?s)<title>(.*?)</title>").alias("title"),
        one("(?s)<h1>(.*?)</h1>").alias("heading"),
        F.array_join(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), " ").alias("links"),
        F.size(F.regexp_extract_all(article, F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).cast("long").alias("paragraphs"),
        F.sha2(F.trim(F.regexp_replace(F.regexp_replace(article, "<[^>]+>", " "), " +", " ")), 256).alias("body"),
    )
