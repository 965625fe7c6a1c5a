"""Graphs and hierarchies (G)."""

from pyspark.sql import functions as F

from cairn.functions.names import slug
from cairn.operators import graphs as G
from cairn.plans.registry import query

WORD_EDGES = "(SELECT DISTINCT string_split(p_name, ' ')[1] || string_split(p_brand, '#')[2] AS a, string_split(p_name, ' ')[2] || string_split(p_brand, '#')[2] AS b FROM part)"
REACH = f"e AS (SELECT a, b FROM {WORD_EDGES} UNION SELECT b, a FROM {WORD_EDGES}), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS node, min(b) AS root FROM r GROUP BY a)"


def word_edges(t):
    """Words of part names that stand together in a part of one brand."""
    w, brand = F.split("p_name", " "), F.split("p_brand", "#")[1]
    return t.part.select(F.concat(w[0], brand).alias("a"), F.concat(w[1], brand).alias("b")).distinct()


@query("g01_components", f"WITH RECURSIVE {REACH} SELECT node, root FROM c")
def g01(t):
    return G.components(word_edges(t))


@query("g02_canonical_members", f"WITH RECURSIVE {REACH}, n AS (SELECT string_split(p_name, ' ')[2] || string_split(p_brand, '#')[2] AS node, count(*) AS n FROM part GROUP BY 1), m AS (SELECT root, c.node, coalesce(n, 0) AS n FROM c LEFT JOIN n ON c.node = n.node) SELECT root, arg_min(node, (-n, node)) AS canonical, CAST(sum(n) AS BIGINT) AS total, count(*) - 1 AS n_aliases FROM m GROUP BY root")
def g02(t):
    n = t.part.groupBy(F.concat(F.split("p_name", " ")[1], F.split("p_brand", "#")[1]).alias("node")).agg(F.count("*").alias("n"))
    members = G.components(word_edges(t)).join(n, "node", "left").fillna(0, ["n"])
    return members.groupBy("root").agg(F.min_by("node", F.struct(-F.col("n"), F.col("node"))).alias("canonical"), F.sum("n").alias("total"), (F.count("*") - 1).alias("n_aliases"))


#: Verdicts join a part to the one that has half its key; equal names join too, but for the names of an exclusion list.
PAIRS = "(SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_size = 7 AND p_partkey > 1)"
SAME = "(SELECT p_partkey AS a, min(p_partkey) OVER (PARTITION BY lower(p_name), p_brand) AS b FROM part WHERE lower(p_name) NOT IN ('red widget', 'blue bolt'))"


@query("g01_verdicts_and_names", f"WITH RECURSIVE e0 AS (SELECT a, b FROM {PAIRS} UNION SELECT a, b FROM {SAME} WHERE a <> b), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, min(b) AS root FROM r GROUP BY a")
def g01_both(t):
    """Two kinds of edges: verdicts on pairs, and equal normalised names within a brand but for those excluded."""
    pairs = t.part.filter("p_size = 7 and p_partkey > 1").select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 2).alias("b"))
    named = t.part.select("p_partkey", F.lower("p_name").alias("name"), "p_brand").filter(~F.col("name").isin("red widget", "blue bolt"))
    least = named.groupBy("name", "p_brand").agg(F.min("p_partkey").alias("b"))
    return G.components(pairs.unionByName(named.join(least, ["name", "p_brand"]).select(F.col("p_partkey").alias("a"), "b")))


TREE = "(SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 > 0)"
CLOSURE = f"a(node, ancestor, depth) AS (SELECT child, parent, 1 FROM {TREE} UNION ALL SELECT a.node, t.parent, depth + 1 FROM a JOIN {TREE} t ON a.ancestor = t.child)"


def tree(t):
    """Parts as a tree: each part's parent has a third of its key."""
    return t.part.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent")).filter("parent > 0")


@query("g03_ancestors", f"WITH RECURSIVE {CLOSURE} SELECT node, ancestor, depth FROM a")
def g03(t):
    return G.ancestors(tree(t), "child", "parent")


@query("g04_transitive_reduction", f"SELECT parent, child FROM {TREE}")
def g04(t):
    closed = G.ancestors(tree(t), "child", "parent").select(F.col("ancestor").alias("parent"), F.col("node").alias("child"))
    return G.reduce_edges(closed)


@query("g05_delimited_ancestors", "WITH e AS (SELECT DISTINCT unnest(['STANDARD', 'root', 'root']) AS parent, unnest([string_split(p_name, ' ')[1], string_split(p_name, ' ')[1], 'STANDARD']) AS child FROM part WHERE p_type LIKE 'STANDARD%') SELECT parent, child FROM e WHERE NOT (parent = 'root' AND child <> 'STANDARD')")
def g05(t):
    w = F.split("p_name", " ")
    rows = t.part.filter(F.col("p_type").like("STANDARD%")).select(w[0].alias("child"), F.lit("STANDARD | root").alias("within"))
    listed = rows.select(F.explode(F.split("within", r" \| ")).alias("parent"), "child").unionByName(rows.select(F.lit("root").alias("parent"), F.lit("STANDARD").alias("child")))
    return G.reduce_edges(listed)


@query("g06_roles", "WITH e AS (SELECT DISTINCT p_type AS parent, string_split(p_name, ' ')[1] AS child FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1], string_split(p_name, ' ')[2] FROM part), n AS (SELECT parent AS node FROM e UNION SELECT child FROM e) SELECT node, node NOT IN (SELECT child FROM e) AS is_root, node NOT IN (SELECT parent FROM e) AS is_leaf, (SELECT count(*) FROM e WHERE child = node) AS parents FROM n")
def g06(t):
    w = F.split("p_name", " ")
    e = t.part.select(F.col("p_type").alias("parent"), w[0].alias("child")).unionByName(t.part.select(w[0].alias("parent"), w[1].alias("child")))
    return G.roles(e)


@query("g07_flat_hierarchy", "SELECT r_name AS parent, n_name AS child, 1 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT DISTINCT r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE false")
def g07(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return G.level_edges(rows, ["r_name", "n_name", "s_name"], "n_nationkey")


@query("g08_nested_hierarchy", "SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'world', r_name FROM region")
def g08(t):
    nested = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_set("n_name").alias("nations"))
    inner = nested.select(F.col("r_name").alias("parent"), F.explode("nations").alias("child"))
    return inner.unionByName(t.region.select(F.lit("world").alias("parent"), F.col("r_name").alias("child"))).distinct()


@query("g09_nearest_ancestor", f"WITH RECURSIVE {CLOSURE}, ch AS (SELECT p_partkey AS node, p_partkey AS ancestor, 0 AS depth FROM part UNION ALL SELECT * FROM a), br AS (SELECT p_partkey AS node, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS brand FROM part WHERE p_size > 40), h AS (SELECT ch.node, brand, depth FROM ch JOIN br ON ch.ancestor = br.node QUALIFY row_number() OVER (PARTITION BY ch.node ORDER BY depth) = 1) SELECT p_partkey AS node, brand, depth FROM part LEFT JOIN h ON p_partkey = h.node")
def g09(t):
    bridge = t.part.filter("p_size > 40").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("brand"))
    return G.nearest_attribution(t.part.select(F.col("p_partkey").alias("node")), G.ancestors(tree(t), "child", "parent"), bridge, "brand")


@query("g10_scoped_rules", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' AND regexp_matches(p_type, 'MO$') THEN 'a' WHEN p_brand = 'Brand#11' AND regexp_matches(p_type, 'LARGE|PROMO') THEN 'b' WHEN p_brand = 'Brand#2' AND regexp_matches(p_type, '^ECONOMY') THEN 'c' END AS rule FROM part")
def g10(t):
    rules = [("Brand#11", "MO$", "a"), ("Brand#11", "LARGE|PROMO", "b"), ("Brand#2", "^ECONOMY", "c")]
    return t.part.select("p_partkey", G.first_rule(t.part, "p_brand", "p_type", rules).alias("rule"))


@query("g11_remainder_lookup", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON replace(lower(c_name), 'customer#', 'supplier-') = replace(lower(s_name), '#', '-') WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def g11(t):
    """What has no urgent order is looked up by its slug."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    rest = t.customer.join(urgent, "c_custkey", "left_anti").withColumn("k", slug(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))))
    return rest.join(t.supplier.withColumn("k", slug("s_name")), "k").select("c_custkey", "s_suppkey")


@query("g12_tree_validation", "SELECT 'duplicate name' AS problem, count(*) AS n FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) UNION ALL SELECT 'missing parent', count(*) FROM part WHERE p_partkey + 100 NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'not one catch-all', count(*) FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size = 50) <> 1)")
def g12(t):
    n = lambda df, problem: df.agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n")
    twice = t.part.groupBy("p_name").agg(F.count("*").alias("c")).filter("c > 1")
    orphans = t.part.select((F.col("p_partkey") + 100).alias("parent")).join(t.part.select(F.col("p_partkey").alias("parent")), "parent", "left_anti")
    catch = t.part.groupBy("p_brand").agg(F.count_if(F.col("p_size") == 50).alias("c")).filter("c <> 1")
    return n(twice, "duplicate name").unionByName(n(orphans, "missing parent")).unionByName(n(catch, "not one catch-all"))


@query("g13_two_pass_insert", "SELECT sha256(r_name) AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name FROM region UNION ALL SELECT sha256(n_name), sha256(r_name), n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def g13(t):
    first = t.region.select(F.sha2("r_name", 256).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), "r_regionkey")
    parents = first.select(F.col("id").alias("parent_id"), "r_regionkey")
    second = t.nation.join(parents, F.col("n_regionkey") == F.col("r_regionkey")).select(F.sha2("n_name", 256).alias("id"), "parent_id", F.col("n_name").alias("name"))
    return first.drop("r_regionkey").unionByName(second)
