"""Arrays, maps and JSON (M)."""

from pyspark.sql import functions as F

from cairn.functions import nested as M
from cairn.operators.dedup import filled_fields
from cairn.plans.registry import query
from cairn.plans.scans import chunked
from cairn.session import shared_dir, spread


def tagged(t):
    """Parts with their attributes as tags."""
    tags = F.array(F.concat(F.lit("brand: "), "p_brand"), F.concat(F.lit("Type:"), "p_type"), F.lit("type: "), F.concat(F.lit("size:"), F.col("p_size").cast("string")), F.concat(F.lit("TYPE:x"), "p_size"))
    return t.part.select("p_partkey", tags.alias("tags"))


@query("m01_first_tag", "SELECT p_partkey, p_brand AS brand, CAST(NULL AS VARCHAR) AS absent FROM part")
def m01(t):
    return tagged(t).select("p_partkey", M.tag_value(F.col("tags"), "brand").alias("brand"), M.tag_value(F.col("tags"), "none").alias("absent"))


@query("m02_all_tags", "SELECT p_partkey, p_type || '|x' || p_size AS kinds FROM part")
def m02(t):
    return tagged(t).select("p_partkey", F.array_join(M.tag_values(F.col("tags"), "type"), "|").alias("kinds"))


@query("m03_tag_struct", "SELECT p_partkey, p_brand AS brand, 'x' || p_size AS kind, p_size AS size FROM part")
def m03(t):
    v = lambda k: M.last_tag_value(F.col("tags"), k)
    return tagged(t).select("p_partkey", v("brand").alias("brand"), v("type").alias("kind"), v("size").cast("int").alias("size"))


@query("m04_attribute", "SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey")
def m04(t):
    attributes = F.array(F.struct(F.lit("key").alias("name"), F.array(F.col("o_custkey").cast("string")).alias("terms")), F.struct(F.lit("status").alias("name"), F.array_sort(F.collect_set("o_orderstatus")).alias("terms")))
    rows = t.orders.groupBy("o_custkey").agg(attributes.alias("a"))
    return rows.select("o_custkey", M.attribute(F.col("a"), "status").alias("status"))


@query("m05_without_keys", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"t\":\"' || event_type || '\"}' END AS rest FROM events")
def m05(t):
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("1"), F.lit("t"), F.col("event_type"))).otherwise(F.create_map(F.lit("k"), F.lit("1")))
    return t.events.select("event_id", F.to_json(M.without_keys(m, ["k"])).alias("rest"))


@query("m06_promote_key", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END, json_extract_string(props, '$.k')) AS k FROM events")
def m06(t):
    own = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string"))
    return t.events.select("event_id", F.coalesce(F.nullif(own, F.lit("")), F.get_json_object("props", "$.k")).alias("k"))


@query("m07_blend", """
SELECT p_partkey, i, name, pct FROM (
  SELECT p_partkey, p_size, unnest([0, 1, 2]) AS i, unnest([w[1] || ' ' || w[2], w[2], w[1]]) AS name, unnest([CAST(p_size AS DOUBLE), NULL, NULL]) AS pct
  FROM (SELECT *, string_split(p_name, ' ') AS w FROM part))
WHERE p_size % 5 > 1""")
def m07(t):
    """Blends as they are written, a fifth of them unknown and a fifth elsewhere."""
    w = F.split("p_name", " ")
    text = F.concat(F.when(F.col("p_size") % 5 == 2, "Approximately ").otherwise(""), F.col("p_size").cast("string"), F.lit("% "), w[0], F.lit(" "), w[1], F.lit(" (old) and "), w[1], F.lit(" & 12 / "), w[0], F.lit(", xy"))
    text = F.when(F.col("p_size") % 5 == 0, "N/A").when(F.col("p_size") % 5 == 1, "See below").otherwise(text)
    return t.part.select("p_partkey", F.posexplode(M.blend(text)).alias("i", "b")).select("p_partkey", "i", "b.name", "b.pct")


@query("m08_composition", "SELECT p_partkey, unnest([p_name, string_split(p_name, ' ')[2] || ' of ' || string_split(p_name, ' ')[1]]) AS name, unnest([p_size, 100 - p_size]) AS pct FROM part")
def m08(t):
    """Names of several words, up to the comma."""
    w = F.split("p_name", " ")
    text = F.format_string("%d%% %s, %d%%  %s of %s ", F.col("p_size"), F.col("p_name"), 100 - F.col("p_size"), w[1], w[0])
    return t.part.select("p_partkey", F.explode(M.composition(text)).alias("c")).select("p_partkey", "c.name", "c.pct")


@query("m09_scores_in_context", "SELECT p_partkey, CAST(80 + p_size % 20 AS INT) AS score, CASE WHEN p_size % 2 = 0 THEN 'WA' END AS publication FROM part UNION ALL SELECT p_partkey, 97, 'WS' FROM part")
def m09(t):
    score = (80 + F.col("p_size") % 20).cast("string")
    first = F.concat(F.when(F.col("p_size") % 2 == 0, "Wine <b>Advocate</b> says ").otherwise("They say "), score, F.lit("&nbsp; "), score, F.lit("<i> points</i>, 101 points, 12 points, "), score, F.lit("/100 "))
    text = F.concat(first, F.lit("x" * 250), F.lit("<p>Spectator &amp; co: 97 POINTS and 97  point"))
    find = M.context_scores({"wine advocate": "WA", "spectator": "WS"})
    return t.part.select("p_partkey", F.explode(find(text)).alias("s")).select("p_partkey", "s.score", "s.publication")


@query("m10_two_patterns", "SELECT p_partkey, CASE WHEN p_size = p_size % 7 THEN CAST(p_size AS VARCHAR) ELSE p_size || ',' || p_size % 7 END AS scores FROM part")
def m10(t):
    text = F.format_string("rated %d pts; %d/100", F.col("p_size"), F.col("p_size") % 7)
    a, b = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"(\d+) pts", r"(\d+)/100"))
    # What both patterns give counts once; the order is that of the patterns.
    return t.part.select("p_partkey", F.array_join(F.concat(a, F.array_except(b, a)), ",").alias("scores"))


@query("m10_structured_scores", """
SELECT p_partkey, i, CASE i WHEN 2 THEN 77 ELSE p_size END AS score, CASE i WHEN 0 THEN 'Top ' || p_brand END AS designation,
 CASE i WHEN 0 THEN NULL WHEN 1 THEN string_split(p_name, ' ')[2] ELSE 'The Paper' END AS critic, CASE i WHEN 0 THEN 'The Paper' END AS publication
FROM part, (VALUES (0), (1), (2)) AS v(i)""")
def m10_scores(t):
    """Scores of a publication, of a critic, of the publication once more, and of the same critic once more."""
    w = F.split("p_name", " ")
    text = F.concat(F.format_string("<p><b>%d Points + Top %s</b> &ndash; <em> The Paper </em><br>", F.col("p_size"), F.col("p_brand")), F.format_string("<b>%d points</b> &#8211; %s,<br/>", F.col("p_size"), w[1]), F.format_string("<b>%d Point</b> – The Paper</p><b>77 Points</b> – The Paper<br>", F.col("p_size")), F.format_string("<b>%d Points</b> – %s", F.col("p_size"), w[1]))
    return spread(t.part.select("p_partkey", "p_name", "p_brand", "p_size")).select("p_partkey", F.posexplode(M.structured_scores(text)).alias("i", "s")).select("p_partkey", "i", "s.*")


@query("m11_split_list", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '+') AS parts FROM part")
def m11(t):
    return t.part.select("p_partkey", F.array_join(M.split_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit(" | "))), "+").alias("parts"))


@query("m12_first_element", "SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def m12(t):
    """The first element that a path leads to, of arrays of a bounded number of orders, and the first of a customer's arrays."""
    orders = chunked(t.orders, "o_orderkey", "o_custkey", size=500)
    rows = orders.groupBy("o_custkey", "chunk").agg(F.array_sort(F.collect_list(F.struct("o_orderkey"))).alias("v"))
    return rows.groupBy("o_custkey").agg(F.min(F.get("v", F.lit(0))["o_orderkey"]).alias("first_order"))


@query("m13_filled_fields", "SELECT o_orderkey, (CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END) + 2 AS n FROM orders")
def m13(t):
    rows = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("a"), F.lit("").alias("b"), F.col("o_totalprice").alias("c"), F.col("o_orderpriority").alias("d"))
    return rows.select("o_orderkey", filled_fields(["a", "b", "c", "d"]).alias("n"))


@query("m14_explode_levels", "SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def m14(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    orders = chunked(t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"), "o_orderkey", "o_custkey", size=500)
    orders = orders.groupBy("o_custkey", "chunk").agg(F.collect_list(F.struct("o_orderkey", "lines")).alias("orders"))  # 500 or so
    docs = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "orders")
    per_order = docs.select("c_custkey", F.explode_outer("orders").alias("o"))
    return per_order.select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"), F.explode_outer("o.lines").alias("l_linenumber"))


@query("m14_documents", "SELECT c_custkey, c_name, o_orderkey, l_linenumber, l_quantity AS quantity, l_returnflag AS flag FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def m14_documents(t):
    """Nested documents written as JSON text and imported level by level; half of them name their fields otherwise.

    A customer of many orders has several documents. Levels are exploded as variants, fields are read by either path.
    """
    drifts = F.col("l_orderkey") % 2 == 0
    line = F.when(drifts, F.to_json(F.struct("l_linenumber", F.struct(F.col("l_quantity").alias("amount")).alias("measure"), F.col("l_returnflag").alias("flag")))).otherwise(F.to_json(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.struct(F.col("l_returnflag").alias("code")).alias("flag"))))
    text = lambda rows: F.concat(F.lit("["), F.array_join(F.collect_list(rows), ","), F.lit("]"))
    lines = t.lineitem.select("l_orderkey", line.alias("line")).groupBy("l_orderkey").agg(text("line").alias("lines"))  # the lines of one order
    order = F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ',"items":').otherwise(',"lines":'), F.coalesce("lines", F.lit("[]")), F.lit("}"))
    orders = chunked(t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", order.alias("order")), "o_orderkey", "o_custkey", size=500)
    orders = orders.groupBy("o_custkey", "chunk").agg(text("order").alias("orders"))
    docs = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    path = shared_dir(t._spark, "documents")
    docs.select(F.concat(F.lit('{"key":'), F.col("c_custkey").cast("string"), F.lit(',"name":"'), "c_name", F.lit('","orders":'), F.coalesce("orders", F.lit("[]")), F.lit("}"))).write.text(path)

    spark = t._spark
    either = lambda v, kind, *paths: F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])
    read = spark.read.text(path).select(F.parse_json("value").alias("doc"))
    top = read.select(F.try_variant_get("doc", "$.key", "long").alias("c_custkey"), F.try_variant_get("doc", "$.name", "string").alias("c_name"), F.expr("try_variant_get(doc, '$.orders', 'variant')").alias("orders"))
    per_order = top.lateralJoin(spark.tvf.variant_explode_outer(F.col("orders").outer())).select("c_custkey", "c_name", F.col("value").alias("o"))
    per_order = per_order.select("c_custkey", "c_name", F.try_variant_get("o", "$.id", "long").alias("o_orderkey"), F.expr("coalesce(try_variant_get(o, '$.lines', 'variant'), try_variant_get(o, '$.items', 'variant'))").alias("lines"))
    per_line = per_order.lateralJoin(spark.tvf.variant_explode_outer(F.col("lines").outer())).select("c_custkey", "c_name", "o_orderkey", F.col("value").alias("l"))
    return per_line.select("c_custkey", "c_name", "o_orderkey", either("l", "int", "$.line", "$.l_linenumber").alias("l_linenumber"), either("l", "double", "$.quantity", "$.measure.amount").alias("quantity"), F.coalesce(F.try_variant_get("l", "$.flag.code", "string"), F.try_variant_get("l", "$.flag", "string")).alias("flag"))


@query("m14a_either_name", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def m14a(t):
    renamed = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.replace("props", F.lit('"k"'), F.lit('"key"')))
    m = F.from_json(renamed, "map<string,string>")
    return t.events.select("event_id", F.coalesce(F.try_element_at(m, F.lit("k")), F.try_element_at(m, F.lit("key"))).alias("k"))


@query("m15_unpivot", "SELECT p_partkey, unnest(list_filter([p_brand, CASE WHEN p_size > 25 THEN p_type END, p_name], lambda x: x IS NOT NULL)) AS code FROM part")
def m15(t):
    codes = F.array(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")), F.col("p_name"))
    return t.part.select("p_partkey", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))


@query("m16_positional", "SELECT p_partkey, string_split(p_type, ' ')[1] AS first, string_split(p_type, ' ')[9] AS ninth, list_filter(string_split(p_type, ' '), lambda w: regexp_matches(w, 'O$'))[1] AS worked FROM part")
def m16(t):
    w = F.split("p_type", " ")
    return t.part.select("p_partkey", F.get(w, F.lit(0)).alias("first"), F.get(w, F.lit(8)).alias("ninth"), F.get(F.filter(w, lambda x: x.rlike("O$")), F.lit(0)).alias("worked"))


@query("m17_fenced_json", "SELECT event_id, event_id % 3 > 0 AS valid, CASE WHEN event_id % 3 > 0 THEN 'x' ELSE 'k,x' END AS missing FROM events")
def m17(t):
    raw = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise("no json")
    report = M.key_report(M.unfence(raw), ["k", "x"])
    return t.events.select("event_id", report.alias("r")).select("event_id", "r.valid", F.array_join("r.missing", ",").alias("missing"))


@query("m18_vocabulary", "SELECT p_partkey, coalesce(CASE WHEN list_contains(string_split(p_type, ' '), 'LARGE') THEN 'LARGE' END, CASE WHEN list_contains(string_split(p_type, ' '), 'PROMO') THEN 'PROMO' END, CASE WHEN contains(lower(p_name), 'large') THEN 'LARGE' END, CASE WHEN contains(lower(p_name), 'promo') THEN 'PROMO' END) AS term FROM part")
def m18(t):
    return t.part.select("p_partkey", M.in_vocabulary(F.split("p_type", " "), F.col("p_name"), ["LARGE", "PROMO"]).alias("term"))


@query("m19_namespaced", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w), ' ') AS tags FROM part")
def m19(t):
    raw = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("en:"), w))
    return t.part.select("p_partkey", F.array_join(F.transform(raw, lambda w: F.replace(F.regexp_replace(w, "^[a-z]{2}:", ""), F.lit("-"), F.lit(" "))), " ").alias("tags"))


@query("m20_patch_join", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_type END, s.kind) AS kind, coalesce(s.sku, 'none') AS sku FROM part LEFT JOIN (SELECT l_partkey, 'sold' AS kind, CAST(min(l_orderkey) AS VARCHAR) AS sku FROM lineitem GROUP BY l_partkey) s ON p_partkey = l_partkey")
def m20(t):
    patch = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.lit("sold").alias("patch_kind"), F.min("l_orderkey").cast("string").alias("patch_sku"))
    rows = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("kind"), F.lit("none").alias("sku"))
    return rows.join(patch, "p_partkey", "left").select("p_partkey", F.coalesce("kind", "patch_kind").alias("kind"), F.coalesce("patch_sku", "sku").alias("sku"))
