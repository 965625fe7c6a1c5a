"""Geometry (E) and spatial joins (J14, J31)."""

import pyarrow as pa
from pyspark.sql import functions as F

from cairn.functions import geometry as E
from cairn.operators import spatial as S
from cairn.plans.registry import query
from cairn.plans.scans import chunked
from cairn.session import materialise, spread, tasks_of
from cairn.sources import shapefiles as H


def rings(t):
    """A square ring around each part, and its corners."""
    x, y, r = (F.col("p_partkey") % 97).cast("double"), (F.col("p_partkey") % 53).cast("double"), (F.col("p_size") / 10).cast("double")
    corner = lambda a, b: F.array(x + a * r, y + b * r)
    return t.part.select("p_partkey", "p_size", x.alias("x"), y.alias("y"), r.alias("r"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)).alias("ring"))


XYR = "(SELECT p_partkey, p_size, CAST(p_partkey % 97 AS DOUBLE) AS x, CAST(p_partkey % 53 AS DOUBLE) AS y, p_size / 10 AS r FROM part)"


@query("e01_centroid", f"SELECT p_partkey, round((5 * x - r) / 5, 6) AS lng, round((5 * y - r) / 5, 6) AS lat FROM {XYR}")
def e01(t):
    c = rings(t).select("p_partkey", E.centroid(F.col("ring")).alias("c"))
    return c.select("p_partkey", F.round("c.lng", 6).alias("lng"), F.round("c.lat", 6).alias("lat"))


@query("e02_haversine", "SELECT c_custkey, round(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km FROM (SELECT c_custkey, pow(sin(radians(la2 - la1) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * pow(sin(radians(lo2 - lo1) / 2), 2) AS h FROM (SELECT c_custkey, c_nationkey * 3.0 - 40 AS la1, c_nationkey * 7.0 - 90 AS lo1, c_custkey % 90 - 45.0 AS la2, c_custkey % 180 - 90.0 AS lo2 FROM customer))")
def e02(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.select("c_custkey", F.round(E.haversine_km(n * 3.0 - 40, n * 7.0 - 90, k % 90 - 45.0, k % 180 - 90.0), 4).alias("km"))


@query("e03_rounded", "SELECT p_partkey, p_partkey / 1024 + 0.0 AS x, CASE WHEN p_partkey % 256 <> 128 THEN round(p_partkey / 1024, 2) ELSE 2 * round(p_partkey * 100 / 2048) / 100 END AS rounded FROM part")
def e03(t):
    """Ties, which are eighths here, go to the even neighbour."""
    x = F.col("p_partkey") / 1024
    return t.part.select("p_partkey", x.alias("x"), E.rounded(F.array(F.array(x)), 2)[0][0].alias("rounded"))


@query("e04_simplify")
def e04(t):
    ring = E.regular_ring(F.col("x"), F.col("y"), F.col("r") + 0.1, 64)
    return spread(rings(t).select("p_partkey", "x", "y", "r")).select("p_partkey", F.size(E.simplify(0.05)(ring)).alias("n_points"))


@query("e05_simplify_to_size")
def e05(t):
    """Points of a ring of 64 corners, which fits the size as it is, and of one of 128, which fits only after one to four of the tolerances."""
    ring = lambda corners: E.regular_ring(F.col("x"), F.col("y"), F.col("r") + 0.1, corners)
    points = lambda corners: F.size(E.simplify_to(1500)(ring(corners)))
    rows = rings(t).select("p_partkey", "x", "y", "r", F.concat_ws(" ", "x", "y", "r").alias("_ring"))
    rows = rows.repartition(tasks_of(rows.sparkSession), "_ring")  # equal rings come together and are simplified once
    shapes = rows.groupBy("_ring").agg(*[F.any_value(k).alias(k) for k in ("x", "y", "r")])
    found = shapes.select("_ring", points(64).alias("n_points"), points(128).alias("n_points_fine"))
    return rows.join(found.hint("merge"), "_ring").select("p_partkey", "n_points", "n_points_fine")


@query("e06_ring_direction", f"SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN -4 * r * r ELSE 4 * r * r END, 6) AS area, p_size % 2 = 0 AS starts_outer FROM {XYR}")
def e06(t):
    turned = F.when(F.col("p_size") % 2 == 0, F.reverse("ring")).otherwise(F.col("ring"))
    area = E.signed_area(turned)
    return rings(t).select("p_partkey", F.round(area, 6).alias("area"), (area < 0).alias("starts_outer"))


def notched(t):
    """Of every other part the ring has a notch in its upper half, half as wide as the ring."""
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    at = lambda a, b: F.array(x + a * r, y + b * r)
    shape = F.array(at(-1, -1), at(1, -1), at(1, 1), at(0.5, 1), at(0.5, 0), at(-0.5, 0), at(-0.5, 1), at(-1, 1), at(-1, -1))
    return rings(t).withColumn("ring", F.when(F.col("p_size") % 2 == 0, shape).otherwise(F.col("ring")))


def inside(t):
    """(outer, inner) of rings that lie in others: notched ones around square ones."""
    outer = notched(t).select(F.col("p_partkey").alias("outer_id"), F.col("ring").alias("outer_ring"))
    inner = rings(t).select(F.col("p_partkey").alias("inner_id"), F.col("ring").alias("inner_ring"))
    return S.pairs_inside(outer, inner)


CONTAINS = f"""SELECT a.p_partkey AS outer_id, b.p_partkey AS inner_id FROM {XYR} a, {XYR} b WHERE a.p_partkey <> b.p_partkey
 AND a.x - a.r <= b.x - b.r + 1e-9 AND a.y - a.r <= b.y - b.r + 1e-9 AND a.x + a.r >= b.x + b.r - 1e-9 AND a.y + a.r >= b.y + b.r - 1e-9
 AND NOT (a.p_size % 2 = 0 AND b.x - b.r < a.x + a.r / 2 - 1e-9 AND b.x + b.r > a.x - a.r / 2 + 1e-9 AND b.y + b.r > a.y + 1e-9)"""
#: Of a box on the sphere: its edges from pole to pole enclose nothing, so the upper and the lower one are left.
ARC = "2 * atan2(tan(radians(2 * {r}) / 2) * 2 * tan(radians({y}) / 2), 1 + pow(tan(radians({y}) / 2), 2))"
AREA = "abs(" + ARC.format(r="{t}.r", y="({t}.y + {t}.r)") + " - " + ARC.format(r="{t}.r", y="({t}.y - {t}.r)") + ")"


@query("e07_contains", CONTAINS)
def e07(t):
    return inside(t).select("outer_id", "inner_id")


@query("e07_area_on_sphere", f"SELECT p_partkey, round({AREA.format(t='a')} * 6371 * 6371, 4) AS km2 FROM {XYR} a")
def e07_area(t):
    return rings(t).select("p_partkey", F.round(E.sphere_area_km2(F.col("ring")), 4).alias("km2"))


SQUARES = CONTAINS[: CONTAINS.index(" AND NOT")]


@query("j14_spatial_join", f"{SQUARES} AND {AREA.format(t='a')} > {AREA.format(t='b')} * 1.01")
def j14(t):
    """Squares inside squares whose area on the sphere is larger by a hundredth."""
    side = lambda p: rings(t).select(F.col("p_partkey").alias(f"{p}_id"), F.col("ring").alias(f"{p}_ring"))
    larger = F.col("outer_area") > F.col("inner_area") * 1.01
    return S.pairs_inside(side("outer"), side("inner"), measures={"area": E.sphere_area_km2}, where=larger).select("outer_id", "inner_id")


#: Squares of a degree that tile a strip for each brand, one above the other and two wide, in the order of its parts.
TILES = "(SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS k FROM part)"


@query("e08_union", f"SELECT p_brand, CAST(count(*) AS DOUBLE) AS area, 1 AS rings, CASE WHEN count(*) % 2 = 1 AND count(*) > 1 THEN 6 ELSE 4 END AS corners FROM {TILES} GROUP BY p_brand")
def e08(t):
    """The union of a brand's squares: area, loops and corners of what the cancelled edges leave."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1  # makes the tiling, as the data have none
    tiles = t.part.select("p_brand", (k % 2).cast("double").alias("x"), F.floor(k / 2).cast("double").alias("y"), (k % 3 == 0).alias("back"))
    corner = lambda a, b: F.array(F.col("x") + a, F.col("y") + b)
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    edges = materialise(S.union_edges(tiles.withColumn("ring", F.when(F.col("back"), F.reverse(ring)).otherwise(ring)), "p_brand", "ring"), "edges")
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    corners = S.corners_only(S.trace(edges, "p_brand"), "p_brand").groupBy("p_brand").agg(F.countDistinct("ring").cast("int").alias("rings"), F.count("*").cast("int").alias("corners"))
    return edges.groupBy("p_brand").agg(F.round(area, 6).alias("area")).join(corners, "p_brand")


def geometries(t):
    """What is known of each part's boundary, as GeoJSON: a polygon, several, a point, or nothing."""
    k = F.col("p_size") % 4
    outline = F.transform("ring", lambda p: F.array(F.round(p[0], 6), F.round(p[1], 6)))
    as_json = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    text = F.when(k == 0, as_json("Polygon", F.array(outline))).when(k == 1, as_json("MultiPolygon", F.array(F.array(outline)))).when(k == 2, as_json("Point", F.array("x", "y")))
    return rings(t).select(F.lit("part").alias("entity_type"), F.col("p_partkey").alias("entity_id"), "x", "y", text.alias("geometry"))


@query("e09_geometry_type", "SELECT p_partkey, p_size % 4 < 2 AS polygon FROM part")
def e09(t):
    """Whether a boundary is there and is one of polygons, by the geometry itself."""
    kind = F.get_json_object("geometry", "$.type")
    return geometries(t).select(F.col("entity_id").alias("p_partkey"), F.coalesce(kind.isin("Polygon", "MultiPolygon"), F.lit(False)).alias("polygon"))


@query("e10_boundaries", f"SELECT p_brand, count(*) AS n, round(min(x - r), 6) AS x0, round(max(x + r), 6) AS x1 FROM {XYR} JOIN (SELECT p_partkey, p_brand FROM part) USING (p_partkey) GROUP BY p_brand")
def e10(t):
    b = rings(t).withColumn("b", E.box(F.col("ring"))).join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    return b.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.min("b.x0"), 6).alias("x0"), F.round(F.max("b.x1"), 6).alias("x1"))


@query("e10_by_entity", f"SELECT l_orderkey, l_linenumber, p_partkey IS NOT NULL AS found, CASE WHEN p_size % 4 < 2 THEN round(x - r, 6) END AS lng, CASE WHEN p_size % 4 < 2 THEN 5 END AS points FROM lineitem LEFT JOIN {XYR} ON l_partkey = p_partkey AND p_size % 5 > 0")
def e10_entity(t):
    """The boundary of the entity that a row names: first corner and number of points of its outer ring, or that there is none."""
    known = geometries(t).join(t.part.filter("p_size % 5 > 0").select(F.col("p_partkey").alias("entity_id")), "entity_id")
    asked = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("part").alias("entity_type"), F.col("l_partkey").alias("entity_id"))
    one, many = F.from_json("geometry", "coordinates array<array<array<double>>>")["coordinates"], F.from_json("geometry", "coordinates array<array<array<array<double>>>>")["coordinates"]
    kind = F.get_json_object("geometry", "$.type")
    ring = F.when(kind == "Polygon", F.get(one, F.lit(0))).when(kind == "MultiPolygon", F.get(F.get(many, F.lit(0)), F.lit(0)))
    found = asked.join(known.withColumn("ring", ring), ["entity_type", "entity_id"], "left")
    return found.select("l_orderkey", "l_linenumber", F.col("x").isNotNull().alias("found"), F.get(F.get("ring", F.lit(0)), F.lit(0)).alias("lng"), F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"))


@query("e11_visible", "SELECT n_name AS selected, s_name AS polygon FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON replace(c_name, 'Customer', 'Supplier') = s_name UNION SELECT n_name, n_name FROM nation")
def e11(t):
    """For each country that can be selected, the polygons to show: those named as one of its points, and its own."""
    points = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("selected"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("polygon"))
    polygons = t.supplier.select(F.col("s_name").alias("polygon"), F.lit("estate").alias("kind")).unionByName(t.nation.select(F.col("n_name").alias("polygon"), F.lit("region").alias("kind")))
    named = polygons.join(points, "polygon")
    own = polygons.filter("kind = 'region'").withColumn("selected", F.col("polygon"))
    return named.unionByName(own.select(*named.columns)).select("selected", "polygon").distinct()


@query("j31_proximity", "SELECT c_custkey FROM (SELECT c_custkey, pow(sin(radians(la2 - la1) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * pow(sin(radians(lo2 - lo1) / 2), 2) AS h FROM (SELECT c_custkey, c_nationkey * 3.0 - 40 AS la1, c_nationkey * 7.0 - 90 AS lo1, c_custkey % 90 - 45.0 AS la2, c_custkey % 180 - 90.0 AS lo2 FROM customer)) WHERE 6371 * 2 * atan2(sqrt(h), sqrt(1 - h)) <= 5000")
def j31(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.filter(E.haversine_km(n * 3.0 - 40, n * 7.0 - 90, k % 90 - 45.0, k % 180 - 90.0) <= 5000).select("c_custkey")


@query("k11_boundary_upsert", f"SELECT p_partkey AS entity_id, 'part' AS entity_type, CASE WHEN p_size > 25 THEN round((5 * x - r) / 5, 6) END AS lng, CASE WHEN p_size > 25 THEN 5 ELSE 0 END AS points, CASE WHEN p_size > 25 THEN 'survey' ELSE 'first import' END AS source FROM {XYR} WHERE p_size > 25 OR p_size % 2 = 0")
def k11(t):
    """Boundaries written on (entity type, entity id): new ones come in, known ones take the new ring and centroid."""
    from cairn.sources.sinks import upsert

    rows = rings(t).withColumn("entity_type", F.lit("part")).withColumnRenamed("p_partkey", "entity_id")
    known = rows.filter("p_size % 2 = 0").select("entity_type", "entity_id", F.lit(None).cast("array<array<double>>").alias("ring"), F.lit(None).cast("double").alias("lng"), F.lit("first import").alias("source"))
    new = rows.filter("p_size > 25").select("entity_type", "entity_id", "ring", F.round(E.centroid(F.col("ring"))["lng"], 6).alias("lng"), F.lit("survey").alias("source"))
    return upsert(known, new, ["entity_type", "entity_id"]).select("entity_id", "entity_type", "lng", F.coalesce(F.size("ring"), F.lit(0)).alias("points"), "source")


GRID = E.EqualArea()
#: Points of a grid in metres, one a customer, from the origin on.
METRES = "(SELECT c_custkey, CAST(c_custkey % 40 * 25000 - 500000 AS DOUBLE) AS east, CAST(c_custkey % 37 * 27000 - 486000 AS DOUBLE) AS north FROM customer)"


@query("s14_reproject", f"""
WITH r AS (SELECT *, sqrt(pow(east / {GRID.d}, 2) + pow(north * {GRID.d}, 2)) AS rho FROM {METRES}), c AS (SELECT *, 2 * asin(rho / (2 * {GRID.radius})) AS c FROM r),
b AS (SELECT *, asin(cos(c) * sin({GRID.beta0}) + CASE WHEN rho = 0 THEN 0.0 ELSE {GRID.d} * north * sin(c) * cos({GRID.beta0}) / rho END) AS beta FROM c)
SELECT c_custkey, round(10 + degrees(atan2(east * sin(c), {GRID.d} * rho * cos({GRID.beta0}) * cos(c) - {GRID.d} * {GRID.d} * north * sin({GRID.beta0}) * sin(c))), 6) AS lng,
 round(degrees(beta + {GRID.series[0]} * sin(2 * beta) + {GRID.series[1]} * sin(4 * beta) + {GRID.series[2]} * sin(6 * beta)), 6) AS lat FROM b""")
def s14(t):
    """Degrees of points in metres of the European equal-area grid."""
    k = F.col("c_custkey")
    p = GRID.degrees(k % 40 * 25000.0 - 500000.0 + GRID.EAST, k % 37 * 27000.0 - 486000.0 + GRID.NORTH)
    return t.customer.select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"))


#: Squares of a few hundred metres, one a part.
SQUARES_IN_METRES = "(SELECT p_partkey, p_name, CAST(p_partkey % 40 * 25000 - 500000 - p_size * 100 AS DOUBLE) AS east, CAST(p_partkey % 37 * 27000 - 486000 - p_size * 100 AS DOUBLE) AS north FROM part)"


@query("s14_shapefiles", f"""
WITH r AS (SELECT *, sqrt(pow(east / {GRID.d}, 2) + pow(north * {GRID.d}, 2)) AS rho FROM {SQUARES_IN_METRES}), c AS (SELECT *, 2 * asin(rho / (2 * {GRID.radius})) AS c FROM r),
b AS (SELECT *, asin(cos(c) * sin({GRID.beta0}) + CASE WHEN rho = 0 THEN 0.0 ELSE {GRID.d} * north * sin(c) * cos({GRID.beta0}) / rho END) AS beta FROM c)
SELECT p_partkey, p_name, 5 AS points, round(10 + degrees(atan2(east * sin(c), {GRID.d} * rho * cos({GRID.beta0}) * cos(c) - {GRID.d} * {GRID.d} * north * sin({GRID.beta0}) * sin(c))), 6) AS lng,
 round(degrees(beta + {GRID.series[0]} * sin(2 * beta) + {GRID.series[1]} * sin(4 * beta) + {GRID.series[2]} * sin(6 * beta)), 6) AS lat FROM b""")
def s14_shapefiles(t):
    """Parts' squares as layers of about 500 shapes with their attributes, read back and turned to degrees."""
    k, half = F.col("p_partkey"), F.col("p_size") * 100.0
    x, y = k % 40 * 25000.0 - 500000.0 + GRID.EAST, k % 37 * 27000.0 - 486000.0 + GRID.NORTH
    corner = lambda a, b: F.array(x + a * half, y + b * half)
    squares = t.part.select("p_partkey", "p_name", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)).alias("ring"))
    layers = chunked(squares, "p_partkey", size=500).repartition("chunk").sortWithinPartitions("chunk", "p_partkey")

    def encode(batches):
        held, chunk = [], None

        def files():
            shp = H.shp_bytes([r["ring"] for r in held])
            dbf = H.dbf_bytes([{"key": r["p_partkey"], "name": r["p_name"]} for r in held], {"key": 12, "name": 80})
            return pa.record_batch([pa.array([f"layers/{chunk}.shp", f"layers/{chunk}.dbf"]), pa.array([shp, dbf])], names=["path", "content"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != chunk and held:
                    yield files()
                    held.clear()
                chunk = r["chunk"]
                held.append(r)
        if held:
            yield files()

    files = materialise(layers.mapInArrow(encode, "path string, content binary"), "layers")
    read = H.read_layers(files).select("attributes", F.explode("parts").alias("ring"))
    first = GRID.degrees(F.get(F.get("ring", F.lit(0)), F.lit(0)), F.get(F.get("ring", F.lit(0)), F.lit(1)))
    kind = t.part.schema["p_partkey"].dataType
    return read.select(F.element_at("attributes", "key").cast(kind).alias("p_partkey"), F.element_at("attributes", "name").alias("p_name"), F.size("ring").alias("points"), first.alias("p")).select("p_partkey", "p_name", "points", F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"))
