"""The twelve relations and their generators on a small world, against recomputation by hand."""

import math

import pytest
from conftest import AREA, OSM, STREETS
from pyspark.sql import functions as F

from terramill.functions import geometry as G
from terramill.operators import corpus, generators, validate
from terramill.operators import relations as R

OX, OY = 650000.0, 6860000.0
CATS = ["cafe", "restaurant", "bar", "hotel", "park"]


def line(*points):
    return [{"x": OX + x, "y": OY + y} for x, y in points]


def jitter(i):
    return ((i * 7919) % 1400) / 100 - 7


POIS = [{"poi_id": i, "poi_name": f"p{i}", "category": CATS[(i % 7 + i // 7) % 5], "x": OX + 100 * (i % 7) + jitter(i), "y": OY + 100 * (i // 7) + jitter(3 * i + 1)} for i in range(49)]
POIS += [{"poi_id": 49 + i, "poi_name": f"h{i}", "category": CATS[i % 5], "x": OX + 100 * (i // 2) + 3, "y": OY + 250 + (20 if i % 2 else -20)} for i in range(12)]
AREAS = [(1, "Park", line((-50, -50), (350, -50), (350, 350), (-50, 350))), (2, "Square", line((400, 400), (650, 400), (650, 650), (400, 650))), (3, "Micro", line((10, 10), (15, 10), (15, 15), (10, 15)))]
ROADS = [(0, "Across", [line((-50, 250), (650, 250))]), (1, "Up", [line((250, -50), (250, 650))]), (2, "Broken", [line((0, 600), (200, 600)), line((260, 600), (500, 600))])]


@pytest.fixture(scope="module")
def world(spark):
    from conftest import Tables

    t = Tables(spark)
    places = corpus.pois(t.make(OSM, POIS)).cache()
    areas = corpus.areas(t.make(AREA, [{"area_id": i, "area_name": n, "category": "park", "rings": [r]} for i, n, r in AREAS])).cache()
    streets = corpus.streets(t.make(STREETS, [{"id_street": i, "street_name": n, "parts": p} for i, n, p in ROADS])).cache()
    return generators.World(places, areas, streets, CATS)


def gap(p, x, y):
    return math.hypot(p["x"] - x, p["y"] - y)


def of(category, skip=()):
    return [p for p in POIS if p["category"] == category and p["poi_id"] not in skip]


def asked(spark, **columns):
    rows = [(i, c, POIS[i]["x"], POIS[i]["y"], i) for i in (0, 10, 24, 48) for c in ("cafe", "bar")]
    df = spark.createDataFrame(rows, "poi long, category string, x double, y double, anchor_index long").withColumn("question_id", F.concat_ws("-", "poi", "category"))
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def answers(df, key="question_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r[key], []).append(r["poi_id"])
    return out


def test_near(spark, world):
    got = answers(R.near(asked(spark), world.places, k=5))
    for i in (0, 10, 24, 48):
        for c in ("cafe", "bar"):
            assert got[f"{i}-{c}"] == [p["poi_id"] for p in sorted(of(c, [i]), key=lambda p: (gap(p, POIS[i]["x"], POIS[i]["y"]), p["poi_id"]))[:5]]


def test_near_all_when_fewer_than_k(spark, world):
    got = answers(R.near(asked(spark), world.places, k=100))
    assert len(got["0-cafe"]) == len(of("cafe", [0]))


def test_near_metric_is_strict(spark, world):
    got = answers(R.near_metric(asked(spark, distance=300), world.places))
    for i in (0, 10, 24, 48):
        want = {p["poi_id"] for p in of("cafe", [i]) if gap(p, POIS[i]["x"], POIS[i]["y"]) < 300}
        assert set(got.get(f"{i}-cafe", [])) == want


def test_cardinal_and_bad_directions(spark, world):
    got = answers(R.near_cardinal(asked(spark, direction="east"), world.places))
    for i in (0, 10, 24, 48):
        a = POIS[i]
        want = {p["poi_id"] for p in of("bar", [i]) if abs((math.degrees(math.atan2(p["x"] - a["x"], p["y"] - a["y"])) % 360 - 90 + 540) % 360 - 180) <= 70}
        assert set(got.get(f"{i}-bar", [])) == want
    for wrong in ("north s", "h so", "outh wes", ""):
        assert R.near_cardinal(asked(spark, direction=wrong), world.places).count() == 0
        with pytest.raises(ValueError):
            generators.point_near_cardinal(world, directions=[wrong])


def test_between_and_coinciding_ends(spark, world):
    a, b = POIS[0], POIS[48]
    q = spark.createDataFrame([(1, "cafe", a["x"], a["y"], b["x"], b["y"], 0, 48), (2, "cafe", a["x"], a["y"], a["x"], a["y"], 0, 0)], "question_id long, category string, x double, y double, bx double, by double, anchor_index long, point_b_index long")
    length = gap(b, a["x"], a["y"])
    ux, uy = (b["x"] - a["x"]) / length, (b["y"] - a["y"]) / length
    want = []
    for p in of("cafe", [0, 48]):
        dx, dy = p["x"] - a["x"], p["y"] - a["y"]
        if 0 <= dx * ux + dy * uy <= length and abs(dx * uy - dy * ux) <= 200:
            want.append((abs(dx * uy - dy * ux), p["poi_id"]))
    assert answers(R.between(q, world.places)) == {1: [i for _, i in sorted(want)]}


def in_box(p, ring):
    return ring[0]["x"] < p["x"] < ring[2]["x"] and ring[0]["y"] < p["y"] < ring[2]["y"]


def to_ring(p, ring):
    def seg(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = max(0, min(1, ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)

    return min(seg(a, b) for a, b in zip(ring, ring[1:] + ring[:1]))


def test_areas(spark, world):
    q = spark.createDataFrame([(i, "cafe") for i, _, _ in AREAS], "area_id long, category string")
    inside, outside = answers(R.inside(q, world.areas, world.places), "area_id"), answers(R.outside(q, world.areas, world.places), "area_id")
    border, solid = answers(R.border(q, world.areas, world.places), "area_id"), answers(R.border(q, world.areas, world.places, solid=True), "area_id")
    north = answers(R.direction_in(q.withColumn("direction", F.lit("north")), world.areas, world.places), "area_id")
    for i, _, ring in AREAS:
        members = [p for p in of("cafe") if in_box(p, ring)]
        assert inside.get(i, []) == sorted(p["poi_id"] for p in members)
        assert outside[i] == [p["poi_id"] for p in sorted((p for p in of("cafe") if p not in members), key=lambda p: to_ring(p, ring))]
        assert border[i] == [p["poi_id"] for p in sorted(of("cafe"), key=lambda p: to_ring(p, ring))]
        assert solid[i][: len(members)] == sorted(p["poi_id"] for p in members)
        assert north.get(i, []) == [p["poi_id"] for p in sorted(members, key=lambda p: -p["y"])]


def test_streets(spark, world):
    q = spark.createDataFrame([(0, "bar"), (2, "bar")], "id_street long, category string")
    got = answers(R.along(q, world.streets, world.places), "id_street")
    assert got[0] == [p["poi_id"] for p in sorted(of("bar"), key=lambda p: (abs(p["y"] - OY - 250), p["poi_id"]))]
    assert {(r["street_a"], r["street_b"]) for r in R.touching_streets(world.streets).collect()} == {(0, 1)}
    assert [(r["x"] - OX, r["y"] - OY) for r in R.crossings(world.streets).collect()] == [(250.0, 250.0)]
    cross = answers(R.cross(spark.createDataFrame([(0, 1, "park"), (0, 2, "park")], "street_a long, street_b long, category string"), R.crossings(world.streets), world.places).withColumn("k", F.concat_ws("-", "street_a", "street_b")), "k")
    assert cross == {"0-1": [p["poi_id"] for p in sorted(of("park"), key=lambda p: gap(p, OX + 250, OY + 250))]}


def test_parallel_streets_touch_but_never_cross(spark, tables):
    streets = corpus.streets(tables.make(STREETS, [{"id_street": 0, "parts": [line((0, 0), (100, 0))]}, {"id_street": 1, "parts": [line((0, 0.5), (100, 0.5))]}, {"id_street": 2}]))
    assert R.touching_streets(streets).count() == 1
    assert R.crossings(streets).count() == 0


def test_opposite_side(spark, world):
    q = spark.createDataFrame([(0, 49, "restaurant")], "id_street long, poi_y long, category string")
    y = POIS[49]
    want = [p for p in of("restaurant", [49]) if (p["y"] > OY + 250) != (y["y"] > OY + 250) and abs(p["y"] - OY - 250) <= 40 and abs(p["x"] - y["x"]) <= 80]
    assert answers(R.opposite_side(q, world.streets, world.places), "poi_y").get(49, []) == [p["poi_id"] for p in sorted(want, key=lambda p: abs(p["x"] - y["x"]))]


def test_measures(spark, world):
    assert {r["area_id"]: r["size"] for r in world.areas.collect()} == {1: 160000.0, 2: 62500.0, 3: 25.0}
    assert {r["id_street"]: r["length"] for r in world.streets.collect()} == {0: 700.0, 1: 700.0, 2: 440.0}
    p = spark.range(1).select(G.lambert93(F.lit(3.0), F.lit(46.5)).alias("o"), G.lambert93(F.lit(2.3522), F.lit(48.8566)).alias("p")).first()
    assert (round(p["o"]["x"], 2), round(p["o"]["y"], 2)) == (700000.0, 6600000.0)
    assert (round(p["p"]["x"], 2), round(p["p"]["y"], 2)) == (652469.02, 6862035.26)


def test_all_categories_of_the_corpus_are_asked(spark, world, tables):
    rows = [p | {"category": f"Ferry Terminal {p['category']}"} for p in POIS]
    w = generators.World(corpus.pois(tables.make(OSM, rows)).cache(), world.areas, world.streets)
    assert w.categories == list(dict.fromkeys(f"ferry_terminal_{p['category']}" for p in POIS))
    assert {r["category_query"] for r in generators.point_near(w, 50).collect()} == set(w.categories)
    assert {r["category_query"] for r in generators.area_border(w, 50).collect()} == set(w.categories)


@pytest.mark.parametrize("name", list(generators.TEMPLATES))
def test_generators_keep_the_contract(world, name):
    t = generators.TEMPLATES[name]
    rows = t.generate(world, 20).withColumn("qid", F.monotonically_increasing_id()).cache()
    assert {*validate.CORE, *validate.LISTS, *t.context} <= set(rows.columns)
    found = rows.collect()
    assert 0 < len(found) <= 20
    assert all(r[t.label] in r["query"] and r["function"] == name and r["category_query"] in r["query"] for r in found)
    assert validate.violations(rows, world.places, "qid", t.dist_is_ranking_key).collect() == []
    # the same again
    assert sorted(r["query"] for r in t.generate(world, 20).collect()) == sorted(r["query"] for r in found)


def test_street_cross_query_answers_every_category_whole(spark, tables, tmp_path):
    from terramill.plans import spatial

    rows = [{"poi_id": i, "category": ["Garden", "ferry terminal"][i % 2], "x": OX + 10.0 * i + jitter(i), "y": OY + 7.0 * i} for i in range(30)]
    tables.make(OSM, rows).write.parquet(f"{tmp_path}/df_osm.parquet")
    roads = [(0, "Across", [line((-50, 50), (650, 50))]), (1, "Up", [line((70, -50), (70, 650))])]
    tables.make(STREETS, [{"id_street": i, "street_name": n, "parts": p} for i, n, p in roads]).write.parquet(f"{tmp_path}/df_streets.parquet")
    got = {}
    for r in sorted(spatial.street_cross(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["street_a"], r["street_b"], r["category"]), []).append((r["poi_id"], r["dist"]))
    expected = {}
    for name, odd in (("garden", 0), ("ferry_terminal", 1)):
        near = sorted((gap(p, OX + 70, OY + 50), p["poi_id"]) for p in rows if p["poi_id"] % 2 == odd)
        expected[0, 1, name] = [(i, round(d, 3)) for d, i in near]
    assert got == expected
