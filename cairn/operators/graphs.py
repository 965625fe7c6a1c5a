"""Graphs and hierarchies on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes that have edges: the least node of each connected component.

    Alternating large and small stars: each round links every node's larger (then smaller)
    neighbours to its least neighbour, until nothing changes and only stars are left. Rounds are
    written as tables; their number grows with the logarithm of the nodes. More than ``max_rounds``
    are an error, never a partial result.
    """
    stars = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "stars")
    state = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        stars = materialise(small.filter("u <> v").distinct(), "stars")
        seen = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) with the least depth of each pair; cycles end where they close.

    Paths are doubled: with all pairs up to depth d, those up to 2d are the pairs of depth d followed by
    any of them, so rounds grow with the logarithm of the depth.
    """
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("node <> ancestor").distinct()
    found, depth = materialise(step.withColumn("depth", F.lit(1)), "ancestors"), 1
    while True:
        far = found.filter(F.col("depth") == depth).select("node", F.col("ancestor").alias("via"))
        on = found.select(F.col("node").alias("via"), F.col("ancestor"), (F.col("depth") + depth).alias("depth"))
        longer = far.join(on, "via").filter("node <> ancestor").select("node", "ancestor", "depth")
        found = materialise(found.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
        depth *= 2
        if found.filter(F.col("depth") == depth).isEmpty():
            return found


def reduce_edges(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Edges of a closed set without those that another parent of the child implies."""
    e = edges.select(parent, child).distinct()
    via = e.select(F.col(parent).alias("_q_parent"), F.col(child).alias("_q"))
    implied = e.select(F.col(parent).alias("_q"), child).join(via, "_q").select(F.col("_q_parent").alias(parent), child)
    return e.join(implied, [parent, child], "left_anti")


def roles(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node, is_root, is_leaf, parents) of every node of an edge table."""
    e = edges.select(parent, child).distinct()
    n = e.groupBy(F.col(child).alias("node")).agg(F.count("*").alias("parents"))
    inner = e.select(F.col(parent).alias("node")).distinct().withColumn("inner", F.lit(True))
    all_nodes = e.select(F.col(parent).alias("node")).unionByName(e.select(F.col(child).alias("node"))).distinct()
    joined = all_nodes.join(n, "node", "left").join(inner, "node", "left")
    return joined.select("node", F.col("parents").isNull().alias("is_root"), F.col("inner").isNull().alias("is_leaf"), F.coalesce("parents", F.lit(0)).cast("long").alias("parents"))


def level_edges(rows: DataFrame, levels: list[str], seq: str) -> DataFrame:
    """(parent, child, level) of flat records; the first parent of a name wins, null levels are skipped."""
    names = F.filter(F.array(*[F.struct(F.col(c).cast("string").alias("name"), F.lit(i).alias("level")) for i, c in enumerate(levels)]), lambda x: x["name"].isNotNull())
    pairs = F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda i: F.struct(F.get("names", i - 1)["name"].alias("parent"), F.get("names", i)["name"].alias("child"), F.get("names", i)["level"].alias("level")))
    flat = rows.select(names.alias("names"), F.col(seq).alias("_q")).filter(F.size("names") > 1).select("_q", F.explode(pairs).alias("e")).select("_q", "e.*")
    return flat.groupBy("child", "level").agg(F.min_by("parent", "_q").alias("parent")).select("parent", "child", "level")


def nearest_attribution(nodes: DataFrame, closure: DataFrame, bridge: DataFrame, value: str) -> DataFrame:
    """(node, value, depth): the node's own bridge, else its closest ancestor's; a null value stops."""
    chain = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).unionByName(closure.select("node", "ancestor", "depth"))
    hit = chain.join(bridge.select(F.col("node").alias("ancestor"), value), "ancestor")
    best = hit.groupBy("node").agg(F.min_by(F.struct(value, "depth"), F.struct("depth", "ancestor")).alias("b"))
    return nodes.select("node").join(best.select("node", f"b.{value}", "b.depth"), "node", "left")


def first_rule(rows: DataFrame, scope: str, text: str, rules: list[tuple[str, str, str]]) -> Column:
    """The value of the first (scope, pattern, value) rule that the row meets."""
    out = F.lit(None).cast("string")
    for s, pattern, value in reversed(rules):
        out = F.when((F.col(scope) == s) & F.col(text).rlike(pattern), F.lit(value)).otherwise(out)
    return out
