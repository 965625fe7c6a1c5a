"""Functions on worked examples and odd values."""

import hashlib
import json
import math
import random
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import geometry, names, nested, parse
from cairn.operators import dedup, graphs, lookups, matching, profile, spatial, survivorship
from cairn.sources import shapefiles, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (names.normalise, "Château Léoville-Las Cases", "chateau leoville las cases"),
        (names.normalise, "Müller-Thurgau", "muller thurgau"),
        (names.normalise, None, ""),
        (names.slug, "López de Heredia", "lopez-de-heredia"),
        (names.slug, "Château d'Yquem", "chateau-d-yquem"),
        (names.producer, "Domaine de la Romanée-Conti", "romanee conti"),
        (names.producer, "Ridge Vineyards", "ridge"),
        (names.product, "Tignanello 2019 750ml", "tignanello"),
        (names.year, "Opus One 2018 Napa Valley", 2018),
        (names.year, "no year 1750", None),
        (names.year, None, None),
        (names.clean, " \0 ", None),
        (names.transliterate, "Θεσσαλονικι", "Thessaloniki"),
        (names.transliterate, "Хисаря Тополь", "Khisarya Topol"),
        (names.transliterate, "Щит, Ъгъл", "Shtit, agal"),
        (parse.area, "1,250.5 ha", 1250.5),
        (parse.area, " 12 hectares", 12.0),
        (parse.area, "about 3 ha", None),
        (parse.new_share, "85% French oak, 30% new", 30.0),
        (parse.new_share, "85% French oak", None),
        (names.title_case, "HOUSE OF THE SUN", "House of the Sun"),
        (names.drop_legal_form, "Acme, Inc.", "Acme"),
        (parse.informal_date, "March 5, 2020", "2020-03-05"),
        (parse.informal_date, "Mai 2020", None),
        (parse.us_date, "2/3/2020", None),
        (parse.number_word, "Seven", 7),
        (parse.guarded_count, "1,200 cases", 1200),
        (parse.guarded_year, "abc", None),
        (nested.unfence, '```json\n{"a": 1}\n```', '{"a": 1}'),
    ],
)
def test_examples(spark, function, text, want):
    assert one(spark, function, text) == want


def test_slug_without_apostrophes(spark):
    assert one(spark, lambda c: names.slug(c, drop_apostrophes=True), "Château d'Yquem") == "chateau-dyquem"


def test_ranges(spark):
    assert tuple(one(spark, parse.number_range, "330–600 m")) == (330, 600)
    assert tuple(one(spark, parse.number_range, "450")) == (450, 450)
    assert tuple(one(spark, parse.number_range, None)) == (None, None)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 7), ("b", 7), ("b", None)], "k string, v int")
    assert {r["k"]: r["median"] for r in profile.upper_median(df, ["k"], "v").collect()} == {"a": 3, "b": 7}


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "x", "fr"), (2, "x", "fr"), (3, "x", "it"), (4, "y", "fr")], "id int, s string, q string")
    assert {r["id"]: r["unique_slug"] for r in dedup.unique_names(df, "s", "q", "id").collect()} == {1: "x", 2: "x-fr", 3: "x-it", 4: "y"}
    for seed in range(4):
        r = random.Random(seed)
        rows = [(i, r.choice(["a", "a", "a-x", "a-x-2", "a-x-2-2", "b", "a-x-3"]), r.choice("xy")) for i in range(60)]
        first, want, taken = {}, {}, set()
        for i, s, q in rows:
            base = s if first.setdefault(s, i) == i else f"{s}-{q}"
            name, n = base, 2
            while name in taken:
                name, n = f"{base}-{n}", n + 1
            taken.add(name)
            want[i] = name
        got = {r["id"]: r["unique_slug"] for r in dedup.unique_names(spark.createDataFrame(rows, "id int, s string, q string"), "s", "q", "id").collect()}
        assert got == want and len(set(got.values())) == 60


def test_components_of_a_path_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ancestors_survive_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "c long, p long")
    got = {(r["node"], r["ancestor"]): r["depth"] for r in graphs.ancestors(edges, "c", "p").collect()}
    assert got[9, 3] == 3
    assert (1, 1) not in got


def test_trigram_pairs_equal_brute_force(spark):
    words = ["alpha", "alpine", "alphas", "beta", "betas", "gamma", "gamut", "", "a"]
    df = spark.createDataFrame([(w,) for w in words], "name string")

    def grams(s):
        p = f"  {s} "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    for threshold in (0.3, 0.5, 0.8):
        want = {(a, b) for a in words for b in words if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= threshold}
        got = {(r["l_name"], r["r_name"]) for r in matching.trigram_pairs(df, df, threshold).collect()}
        assert got == want


def test_lookups_take_the_first_candidate(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, "x", None)], "id int, p string, q string")
    dim = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    got = {r["id"]: (r["v"], r["place"]) for r in lookups.by_candidates(rows, "id", [F.col("p"), F.col("q")], dim, "k", "v").collect()}
    assert got == {1: (10, 0), 2: (20, 1), 3: (None, None)}


def test_merge_keeps_existing_and_reports(spark):
    a = spark.createDataFrame([(1, "", "x", None), (2, "r", "y", "7")], "k int, f string, g string, p string")
    b = spark.createDataFrame([(1, "new", "z", ""), (2, "", "y", "8")], "k int, f string, g string, p string")
    got = {r["k"]: (r["f"], r["g"], r["p"], r["conflicts"]) for r in survivorship.merge_fields(a, b, "k", ["f", "g"], ["p"]).collect()}
    assert got == {1: ("new", "x", "", ["g"]), 2: ("r", "y", "7", ["p"])}


def test_simplify_line_keeps_far_points():
    line = np.array([[0, 0], [1, 0.001], [2, 1], [3, 0], [4, 0]], float)
    assert geometry.simplify_line(line, 0.01).tolist() == [[0, 0], [1, 0.001], [2, 1], [3, 0], [4, 0]]
    assert geometry.simplify_line(line, 2).tolist() == [[0, 0], [4, 0]]


def test_contains_ring_equals_ray_casting(spark):
    rng = random.Random(4)

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    star = [[0.0, 0.0], [8.0, 1.0], [9.0, 9.0], [4.0, 3.0], [1.0, 8.0]]
    rows = [(k, star, [[rng.uniform(0, 9), rng.uniform(0, 9)] for _ in range(rng.choice([1, 2]))]) for k in range(200)] + [(900, None, star), (901, star, None)]
    df = spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>")
    got = {r["k"]: r["c"] for r in df.select("k", geometry.contains_ring(F.col("a"), F.col("b")).alias("c")).collect()}
    steps = np.linspace(0, 1, 3001)
    path = lambda b: [tuple(np.array(b[0]) * (1 - s) + np.array(b[-1]) * s) for s in (steps if len(b) > 1 else [0.0])]
    assert got == {k: None if a is None or b is None else all(inside(*p, a) for p in path(b)) for k, a, b in rows}


def test_names_as_their_rules_say(spark):
    say = lambda f, text: one(spark, f, text)
    assert say(names.producer, "Domaine de la Romanée-Conti") == "romanee conti"
    assert say(names.producer, "Ridge Vineyards") == "ridge"
    assert say(names.producer, "Quinta do Noval") == "noval"
    assert say(names.product, "Tignanello 2019 750ml") == "tignanello"
    assert say(names.product, "Reserve Estate Magnum Gift Box") == "reserve estate"
    assert say(names.drop_legal_form, "Vinos Sur S.A.S.") == "Vinos Sur"
    assert say(names.drop_legal_form, "Cavas, Ltda") == "Cavas"
    assert say(names.decode_entities, "it&#8217;s &mdash; 5&deg; &#x41; &#99999999;  x<br>") == "it’s — 5° &#x41; &#99999999; x"
    assert say(names.clean, "\0 &lsquo;a&rsquo; &#x41; \0") == "‘a’ A"
    assert say(names.trigrams, "ab") == ["  a", " ab", "ab "]


def test_haversine(spark):
    km = spark.range(1).select(geometry.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)).alias("km")).first()["km"]
    assert math.isclose(km, 343.5, abs_tol=1)


def test_scores_in_context(spark):
    find = nested.context_scores({"advocate": "WA"})
    got = one(spark, find, "The Advocate gave 95 points. " + "x " * 300 + "Others 90 pts, <b>91</b> points and 95 points, 79 points")
    assert {(r["score"], r["publication"]) for r in got} == {(95, "WA"), (91, None), (95, None)}


def test_partition_keys_fill_each_partition_once(spark):
    from cairn.session import partition_keys

    keys = partition_keys(spark, 13)
    rows = spark.createDataFrame([(k,) for k in keys], "k int").repartition(13, "k")
    assert rows.rdd.glom().map(len).collect() == [1] * 13


def test_edit_candidates_equal_brute_force(spark):
    words = ["kitten", "sitting", "mitten", "sit", "", "a", "kit", "written"]
    df = spark.createDataFrame([(w,) for w in words], "name string")
    got = {(r["l_name"], r["r_name"]): r["distance"] for r in matching.edit_pairs(df, df, F.lit(3)).collect()}
    plain = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    want = {(r["a"], r["b"]): r["d"] for r in plain.select("a", "b", F.levenshtein("a", "b").alias("d")).filter("d <= 3").collect()}
    assert got == want


def test_workbooks_round_trip(spark, tmp_path):
    from cairn.sources import workbooks

    book = {"One": [["a", None], ["1", "x<&y"], ["2"]], "Skip": [["a"], ["9"]], "Tw o": [["a"], ["é"]]}
    (tmp_path / "b.xlsx").write_bytes(workbooks.build_workbook(book))
    got = {(r["sheet"], r["number"]): r["record"] for r in workbooks.read_workbooks(spark, str(tmp_path), skip=("Skip",)).collect()}
    assert got == {("One", 2): {"a": "1", "col_1": "x<&y"}, ("One", 3): {"a": "2", "col_1": None}, ("Tw o", 2): {"a": "é"}}


def test_positions_follow_a_key_over_ranges(spark):
    df = spark.createDataFrame([(k * 7 % 1001, "x") for k in range(1000)], "k int, v string").repartition(5)
    got = [r["position"] for r in profile.positions(df, "k").orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_by_levels_takes_the_first_level_that_matches(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (4, None)], "id int, name string")
    dim = lambda *pairs: spark.createDataFrame(pairs, "key string, value int")
    got = lookups.by_levels(rows, "id", [(F.col("name"), dim(("a", 7), ("a", 5))), (F.lower("name"), dim(("a", 1), ("b", 2)))])
    assert {r["id"]: (r["value"], r["level"]) for r in got.collect()} == {1: (5, 0), 2: (2, 1), 3: (None, None), 4: (None, None)}


def test_soft_delete_and_restore(spark):
    rows = spark.createDataFrame([(1, None), (2, "old"), (3, None), (4, "old")], "id int, deleted_at string")
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    gone = sinks.soft_delete(rows, keys(1, 2, 2), "id", F.lit("new"))
    assert {r["id"]: r["deleted_at"] for r in gone.collect()} == {1: "new", 2: "old", 3: None, 4: "old"}
    assert {r["id"]: r["deleted_at"] for r in sinks.restore(gone, keys(1, 4), "id").collect()} == {1: None, 2: "old", 3: None, 4: None}


def test_upsert_keeps_keys_unique(spark):
    df = lambda *r: spark.createDataFrame(r, "k int, v string")
    got = sinks.upsert(df((1, "a"), (2, "b")), df((2, "c"), (2, "d"), (3, None)), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "d"), (3, None)]


def test_loops_never_end_with_a_partial_result(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(9)], "a int, b int")
    with pytest.raises(RuntimeError):
        graphs.components(chain, max_rounds=1)
    assert graphs.ancestors(chain, "a", "b").count() == 45


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 700 nodes that ends in a cycle, by ten doublings."""
    rounds, write = [], graphs.materialise
    monkeypatch.setattr(graphs, "materialise", lambda df, tag: rounds.append(tag) or write(df, tag))
    chain = spark.createDataFrame([(k, k + 1) for k in range(700)] + [(700, 698)], "a int, b int")
    got = graphs.ancestors(chain, "a", "b")
    assert got.filter("node = 0").agg(F.count("*"), F.max("depth")).first() == (700, 700)
    assert got.filter("node = 700").count() == 2 and len(rounds) <= 11


BLENDS = [
    ("60% Merlot and 40% Cabernet Franc (old vines)", [("Merlot", 60.0), ("Cabernet Franc", 40.0)]),
    ("Approximately 70 Gamay & Pinot / xy, 12", [("Gamay", 70.0), ("Pinot", None)]),
    ("N/A", []),
    ("Varies by year", []),
    ("see below", []),
    ("see the label, Syrah", [("Syrah", None)]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), BLENDS)
def test_blend(spark, text, want):
    assert [tuple(x) for x in one(spark, nested.blend, text)] == want


def test_composition(spark):
    assert [tuple(x) for x in one(spark, nested.composition, "60% Cabernet Sauvignon, 40%  Merlot of the hill")] == [("Cabernet Sauvignon", 60), ("Merlot of the hill", 40)]


def test_word_trigrams_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("ridge monte bello", "Monte-Bello RIDGE")], "a string, b string")
    assert df.select(names.similarity(names.word_trigrams("a"), names.word_trigrams("b")).alias("s")).first()["s"] == 1.0


@pytest.mark.parametrize("seed", range(2))
def test_edit_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
    a, b = sorted({word() for _ in range(60)}), sorted({word() for _ in range(80)})

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x):
            new = [i + 1]
            for j, q in enumerate(y):
                new.append(min(row[j] + (p != q), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    left, right = (spark.createDataFrame([(x,) for x in side], "name string") for side in (a, b))
    limit = lambda x: max(int(0.3 * len(x)), 1)
    want = {(x, y, lev(x, y)) for x in a for y in b if lev(x, y) <= limit(x)}
    got = matching.edit_pairs(left, right, F.greatest(F.floor(0.3 * F.length("l_name")), F.lit(1)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    in_block = lambda df: df.withColumn("k", F.crc32("name") % 3)
    best = {}
    blocks = {x: k for x, k in [(r["name"], r["k"]) for r in in_block(left).collect()] + [(r["name"], r["k"]) for r in in_block(right).collect()]}
    for x in a:
        near = [(lev(x, y), y) for y in b if blocks[y] == blocks[x]]
        if near:
            best[x] = min(near)[1]
    assert {r["l_name"]: r["r_name"] for r in matching.nearest_by_edits(in_block(left), in_block(right), "k").collect()} == best


NOTCHED = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [6.0, 10.0], [6.0, 4.0], [4.0, 4.0], [4.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
BOXES = [
    ((1, 5, 9, 6), False),  # a bar across the notch: all corners inside
    ((1, 1, 9, 3), True),
    ((0, 0, 10, 4), True),  # along the edges and the bottom of the notch
    ((0, 0, 10, 5), False),
    ((4, 4, 6, 10), False),  # the notch itself
    ((0, 4, 4, 10), True),  # an arm, with three edges in common
    ((11, 1, 12, 2), False),
    ((-1, -1, 11, 11), False),
]


@pytest.mark.parametrize(("box", "want"), BOXES)
def test_rings_inside_a_concave_one(spark, box, want):
    x0, y0, x1, y1 = map(float, box)
    ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    df = spark.createDataFrame([(NOTCHED, ring)], "o array<array<double>>, i array<array<double>>")
    assert df.select(geometry.contains_ring(F.col("o"), F.col("i")).alias("c")).first()["c"] is want


def test_area_on_the_sphere(spark):
    """An eighth of the sphere, and a box of a degree."""
    octant = [[float(x), 0.0] for x in range(0, 91)] + [[90.0, 90.0], [0.0, 90.0], [0.0, 0.0]]
    box = [[10.0, 0.0], [11.0, 0.0], [11.0, 1.0], [10.0, 1.0], [10.0, 0.0]]
    df = spark.createDataFrame([(octant, box)], "a array<array<double>>, b array<array<double>>")
    got = df.select(geometry.sphere_area_km2(F.col("a")).alias("a"), geometry.sphere_area_km2(F.reverse("b")).alias("b")).first()
    assert got["a"] == pytest.approx(4 * math.pi * 6371**2 / 8, rel=1e-9)
    assert got["b"] == pytest.approx(6371**2 * math.radians(1) * math.sin(math.radians(1)), rel=1e-4)  # its upper edge is an arc, not a parallel


def test_equal_area_grid_on_the_published_example(spark):
    grid = geometry.EqualArea()
    df = spark.createDataFrame([(3962799.45, 2999718.85), (4321000.0, 3210000.0)], "x double, y double")
    a, b = [r["p"] for r in df.select(grid.degrees(F.col("x"), F.col("y")).alias("p")).collect()]
    assert (a["lat"], a["lng"]) == pytest.approx((50.0, 5.0), abs=1e-6)
    assert (b["lat"], b["lng"]) == pytest.approx((52.0, 10.0), abs=1e-7)


def plain_simplify(ring, tolerance):
    """Douglas-Peucker by distance to the segment, recursively; a ring left with under 4 points stays."""

    def away(p, a, b):
        (x, y), (ax, ay), (bx, by) = p, a, b
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size)) if size else 0.0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    def keep(points):
        if len(points) < 3:
            return points
        d = [away(p, points[0], points[-1]) for p in points[1:-1]]
        far = max(range(len(d)), key=lambda i: d[i])
        return keep(points[: far + 2])[:-1] + keep(points[far + 1 :]) if d[far] > tolerance else [points[0], points[-1]]

    left = keep(ring)
    return left if len(left) >= 4 else ring


def rings_of(spark):
    from cairn.plans import geometry as plans
    from cairn.plans.registry import Tables

    ring = geometry.regular_ring(F.col("x"), F.col("y"), F.col("r") + 0.1, 64)
    return {r["p_partkey"]: r["ring"] for r in plans.rings(Tables(spark, "/root/testdata/sf0.001")).select("p_partkey", ring.alias("ring")).collect()}


def test_simplified_rings_equal_plain_version(spark):
    from cairn.plans import registry

    rings = rings_of(spark)
    got = {r["p_partkey"]: r["n_points"] for r in registry.queries()["e04_simplify"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: len(plain_simplify(ring, 0.05)) for k, ring in rings.items()}

    def to_size(ring, most=1500):
        near = lambda points: [[round(x, 5) for x in p] for p in points]
        ring = near(ring)
        for tolerance in (0.001, 0.002, 0.005, 0.01):
            if len(json.dumps(ring)) <= most:
                break
            ring = near(plain_simplify(ring, tolerance))
        return ring

    got = {r["p_partkey"]: r["n_points"] for r in registry.queries()["e05_simplify_to_size"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: len(to_size(ring)) for k, ring in rings.items()}


def test_each_tolerance_counts_in_simplifying_to_a_size(spark):
    """Rings of 128 corners stop at different tolerances: without any one of them, others come out."""
    from cairn.plans import geometry as plans
    from cairn.plans import registry

    outline = geometry.regular_ring(F.col("x"), F.col("y"), F.col("r") + 0.1, 128)
    rows = plans.rings(registry.Tables(spark, "/root/testdata/sf0.001")).select("p_partkey", outline.alias("ring")).collect()
    near = lambda points: [[round(x, 5) for x in p] for p in points]

    def to_size(ring, tolerances, most=1500):
        ring = near(ring)
        for tolerance in tolerances:
            if len(json.dumps(ring)) <= most:
                break
            ring = near(plain_simplify(ring, tolerance))
        return ring

    every = (0.001, 0.002, 0.005, 0.01)
    sizes = lambda tolerances: {r["p_partkey"]: len(to_size(r["ring"], tolerances)) for r in rows}
    got = {r["p_partkey"]: r["n_points_fine"] for r in registry.queries()["e05_simplify_to_size"](spark, "/root/testdata/sf0.001").collect()}
    assert got == sizes(every) and max(got.values()) < 129
    assert all(got != sizes([t for t in every if t != left_out]) for left_out in every)


def test_folder_walk_lists_every_file(spark):
    from cairn.plans import registry

    got = {r["name"]: r["bytes"] for r in registry.queries()["s15_folder_walk"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {p.name: p.stat().st_size for p in Path("/root/testdata/sf0.001").glob("*.parquet")}


@pytest.mark.parametrize("seed", range(3))
def test_resolve_or_create_equals_going_row_by_row(spark, seed):
    """Misspelled newcomers: who comes first makes the entity that later ones match."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdefgh") for _ in range(r.randint(4, 9))) for _ in range(9)]

    def listed():
        words = [r.choice(stems) for _ in range(r.choice([1, 1, 2]))]
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(words))
            at = r.randrange(len(words[i]) + 1)
            words[i] = words[i][:at] + r.choice(["", "x", "yy"]) + words[i][at + r.randint(0, 1) :]
        return " ".join(w for w in words if w) or "zz"

    rows = [(i, None if r.random() < 0.05 else listed()) for i in range(90)]
    existing = [(f"e{i}", listed()) for i in range(6)]

    def grams(text):
        return {f"  {w} "[i : i + 3] for w in text.lower().split() for i in range(len(w) + 1)}

    entities = [(-1, i, n) for i, n in existing]
    want = {}
    for i, n in rows:
        if n is None:
            want[i] = (None, None)
            continue
        exact = sorted(e for _, e, m in entities if m == n)
        near = [(-len(grams(n) & grams(m)) / len(grams(n) | grams(m)), since, e) for since, e, m in entities]
        near = [x for x in near if -x[0] > 0.4]
        if exact:
            want[i] = (exact[0], "exact")
        elif near:
            want[i] = (min(near)[2], "fuzzy")
        else:
            made = hashlib.sha256(n.encode()).hexdigest()
            entities.append((i, made, n))
            want[i] = (made, "created")
    df = spark.createDataFrame(rows, "seq int, listing string")
    known = spark.createDataFrame(existing, "key string, label string")
    got = {x["seq"]: (x["id"], x["tier"]) for x in survivorship.resolve_or_create(df, "listing", "seq", known, "label", "key").collect()}
    assert got == want
    assert {t for _, t in want.values()} >= {"created", "fuzzy", "exact"}


def test_failing_batches(spark):
    """Good rows of a bad batch go in, and each refused row says why."""
    rows = [(i, "x" if i % 37 == 5 else None if i % 50 == 7 else str(i / 2), "n") for i in range(1000)]
    target = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType(), False)])
    good, bad = sinks.insert_batches(spark.createDataFrame(rows, "k long, v string, more string"), target, 64)
    refused = {i for i, v, _ in rows if v in ("x", None)}
    assert {(x["k"], x["v"]) for x in good.collect()} == {(i, i / 2) for i, _, _ in rows if i not in refused}
    told = {json.loads(x["row"])["k"]: x["error"] for x in bad.collect()}
    assert set(told) == refused and "null in column v" in told[7] and "x" in told[5]
    none = sinks.insert_batches(spark.createDataFrame([], "k long, v string"), target)
    assert none[0].count() == none[1].count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_union_of_tiles(spark, seed):
    """Random cells of a grid: holes, parts that touch in a corner, rings in either direction."""
    r = random.Random(seed)
    cells = {(k, x, y) for k in ("a", "b") for x in range(5) for y in range(5) if r.random() < 0.6}
    rows = []
    for k, x, y in cells:
        ring = [[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]
        rows.append((k, [[float(c) for c in p] for p in (ring if r.random() < 0.5 else ring[::-1])]))
    edges = spatial.union_edges(spark.createDataFrame(rows, "k string, ring array<array<double>>"), "k", "ring")
    traced = spatial.trace(edges, "k").collect()
    loops = {}
    for t in traced:
        loops.setdefault((t["k"], tuple(t["ring"])), {}).setdefault(t["seq"], []).append((t["x"], t["y"]))
    area = {"a": 0.0, "b": 0.0}
    for (k, _), places in loops.items():
        # Loops that begin in the same corner share a name only if they are one.
        assert sorted(places) == list(range(len(places))) and all(len(p) == 1 for p in places.values())
        points = [places[i][0] for i in range(len(places))]
        assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(points, points[1:] + points[:1], strict=True))
        area[k] += sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(points, points[1:] + points[:1], strict=True)) / 2
    assert area == {k: float(sum(c[0] == k for c in cells)) for k in "ab"}


def test_shapefiles_from_disk(spark, tmp_path):
    """Polygons with attributes, a deleted record, points and null shapes; another file beside them."""
    ring = [[0.0, 0.0], [2.0, 0.0], [1.0, 3.5], [0.0, 0.0]]
    rows = [{"key": "1", "name": "Zürich"}, {"key": "2", "name": ""}, {"key": "3", "name": "x"}]
    (tmp_path / "a.shp").write_bytes(shapefiles.shp_bytes([ring, ring[::-1], ring]))
    dbf = bytearray(shapefiles.dbf_bytes(rows, {"key": 4, "name": 10}))
    dbf[-16] = ord("*")
    (tmp_path / "a.dbf").write_bytes(bytes(dbf))
    body = struct.pack(">ii", 1, 10) + struct.pack("<i2d", 1, 7.0, -8.0) + struct.pack(">ii", 2, 2) + struct.pack("<i", 0)
    (tmp_path / "b.SHP").write_bytes(struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 1, *[0.0] * 8) + body)
    (tmp_path / "a.txt").write_text("no shapes")
    got = shapefiles.read_layers(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {(r["layer"], r["record"]): (r["kind"], r["parts"], r["attributes"]) for r in got} == {
        ("a", 1): (5, [ring], {"key": "1", "name": "Zürich"}),
        ("a", 2): (5, [ring[::-1]], {"key": "2", "name": None}),
        ("a", 3): (5, [ring], None),
        ("b", 1): (1, [[[7.0, -8.0]]], None),
        ("b", 2): (0, None, None),
    }
    with pytest.raises(ValueError):
        list(shapefiles.shapes_of(b"x" * 200))


@pytest.mark.parametrize("seed", range(2))
def test_contained_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ab ") for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])))
    a, b = ([(k, word()) for k in "xy" for _ in range(40)] for _ in range(2))
    want = {(k, m, n) for k, m in a for l, n in b if k == l and (m in n or n in m)}
    got = matching.contained_pairs(*[spark.createDataFrame(side, "k string, name string") for side in (a, b)], "k")
    assert {tuple(x) for x in got.collect()} == want
