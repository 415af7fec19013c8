"""Question stream, question sets on disk, extracts, cleaning and sampling."""

import json

import pytest
from conftest import OSM
from pyspark.sql import functions as F

from terramill import streaming
from terramill.functions import cuisine, features, wkb
from terramill.operators import corpus, sampling, semantic, validate
from terramill.operators import relations as R
from terramill.sources import extracts
from terramill.sources import question_sets as Q


def test_stream_equals_batch(spark, tables, tmp_path):
    places = corpus.pois(tables.make(OSM, [{"poi_id": i, "category": "cafe", "x": float(i * 10), "y": 1.0} for i in range(30)]))
    asked = spark.createDataFrame([(i, "cafe", float(i * 50), 0.0, None) for i in range(6)], "question_id long, category string, x double, y double, anchor_index long")
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streaming.answer_stream(stream, places, lambda q, p: R.near(q, p, 3), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("question_id", "poi_id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.near(asked, places, 3).select("question_id", "poi_id", "rank").collect()))


SET = "question_id long, query string, category_query string, function string, anchor_index long, area_geometry array<array<struct<x:double,y:double>>>, results_poi_id array<long>, results_poi_name array<string>, results_poi_dist array<double>, results_poi_rank array<int>"


def question_set(spark):
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]
    return spark.createDataFrame([
        (1, "cafe near A", "cafe", "point_near", 9, ring, [1, 2], ["a", "b"], [1.0, 2.0], [1, 2]),
        (2, "cafe near B", "cafe", "point_near", 2, None, [2, 2], ["b", "b"], [3.0, 2.0], [1, 3]),
        (3, "bar", "cafe", "point_near", 9, None, [1, 7], ["a", "x"], [1.0, float("nan")], [1, 2]),
        (4, " ", "cafe", "area_inside", None, [], None, None, None, None),
        (5, "cafe here", "cafe", "area_inside", None, None, [1, 2], ["b", "b"], [1.0], [1, 2]),
        (6, "cafe here", "cafe", "area_inside", None, None, [1, 3], ["z", "c"], [-1.0, 1.0], [1, 2]),
    ], SET)


def test_violations(spark):
    places = spark.createDataFrame([(1, "a", "cafe"), (2, "b", "cafe"), (3, "c", "bar")], "poi_id long, poi_name string, category string")
    got = {(r["question_id"], r["check"]): r["n"] for r in validate.violations(question_set(spark), places).collect()}
    assert got == {
        (2, "duplicate_ids"): 1, (2, "bad_rank"): 1, (2, "falling_distance"): 1, (2, "anchor_index_in_answer"): 1, (3, "bad_distance"): 1, (3, "query_without_category"): 1,
        (3, "unknown_poi"): 1, (4, "empty_answer"): 1, (5, "not_parallel"): 1, (6, "negative_distance"): 1, (6, "wrong_name"): 1, (6, "wrong_category"): 1,
    }
    with pytest.raises(ValueError):
        validate.violations(question_set(spark).drop("query"))


def test_save_and_load(spark, tmp_path):
    rows, path = question_set(spark), f"file://{tmp_path}/one"
    with pytest.raises(ValueError):
        Q.save(rows, path, validate="raise")
    with pytest.raises(ValueError):
        Q.save(rows, path, validate="maybe")
    assert Q.save(rows, path, meta={"seed": 1}).endswith("one.parquet")
    with pytest.raises(FileExistsError):
        Q.save(rows, path)
    Q.save(rows.where("question_id = 1"), path, validate="raise", overwrite=True, meta={"seed": 2})
    back, meta = Q.load(spark, path, with_meta=True)
    assert back.first() == rows.where("question_id = 1").first()
    assert meta["seed"] == 2 and meta["n_questions"] == 1 and meta["answer_sizes"]["median"] == 2 and meta["questions_by_category"] == {"cafe": 1}
    Q.write_text(spark, f"file://{tmp_path}/one.meta.json", json.dumps({"format_version": 99}))
    with pytest.raises(ValueError):
        Q.load(spark, path)
    Q.save_suite({"b": rows, "a": rows}, f"file://{tmp_path}/suite", validate=None)
    assert list(Q.load_suite(spark, f"file://{tmp_path}/suite")) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        Q.load_suite(spark, f"file://{tmp_path}/none")


def test_wkb_round_trip(spark):
    rows = spark.createDataFrame([([[(0.0, 0.0), (1.0, 2.0), (3.0, 4.0)], [(1.0, 1.0), (2.0, 2.0)]],), ([],), (None,)], "r array<array<struct<x:double,y:double>>>")
    got = rows.select("r", wkb.wkb_to_rings(wkb.rings_to_wkb("r")).alias("polygon"), wkb.wkb_to_rings(wkb.parts_to_wkb("r")).alias("line")).collect()
    assert got[0]["polygon"] == got[0]["line"] == got[0]["r"] and got[1]["polygon"] is None and got[2]["line"] is None
    point = spark.range(1).select(wkb.point_xy(wkb.xy_to_wkb(F.lit(1.5), F.lit(-2.25))).alias("p")).first()["p"]
    assert (point["x"], point["y"]) == (1.5, -2.25)


@pytest.mark.parametrize("raw, tokens, pick", [
    ("Japanese;sushi;JAPANESE", ["japanese", "sushi"], "japanese"), ("japanese;bowl;poke", ["japanese", "bowl", "poke"], "japanese"), (" Coffee Shop / Cuisine Française", ["coffee_shop", "cuisine_francaise"], None),
    ("française|Steakhouse", ["french", "steak_house"], "french"), ("Japanese Restaurant", ["japanese"], "japanese"), ("steak house", ["steak_house"], "steakhouse"), (None, [], None), (" ; ,", [], None),
])
def test_cuisine(spark, raw, tokens, pick):
    got = cuisine.classify_cuisine(spark.createDataFrame([(raw,)], "cuisine string")).first()
    if raw == "steak house":  # the suffix goes first, then the synonym brings it back
        tokens = ["steak_house"]
    assert got["cuisine_tokens"] == tokens and got["cuisine"] == pick


def test_cuisine_options_and_reports(spark):
    rows = spark.createDataFrame([("japanese;bowl",), ("bar",), ("blorp",), ("blorp;vegan",), (None,)], "cuisine string")
    assert cuisine.classify_cuisine(rows, prefer="dish").first()["cuisine"] == "bowl"
    assert cuisine.classify_cuisine(rows, keep_venue=True).collect()[1]["cuisine"] == "bar"
    assert cuisine.classify_cuisine(rows, synonyms={"blorp": "thai"}).collect()[2]["cuisine"] == "thai"
    assert [tuple(r) for r in cuisine.unknown_report(rows).collect()] == [("blorp", 2)]
    assert tuple(cuisine.coverage_report(rows).first()) == (5, 1, 4, 0.2)
    assert tuple(cuisine.coverage_report(rows.limit(0)).first()) == (0, 0, 0, 0.0)
    assert cuisine.closest_known(spark.createDataFrame([("japanes",)], "token string")).first()["proposed"] == "japanese"


def test_serialize(spark):
    rows = spark.createDataFrame([("Chez X", "fast_food", "bakery;cafe", "yes", "no", "Rue A", "75001")], "name string, amenity string, shop string, outdoor_seating string, indoor_seating string, `addr:street` string, `addr:postcode` string")
    text = rows.select(features.serialize(["amenity", "outdoor_seating", "indoor_seating"], rows.columns, name_tags=["name"], category_tags=["amenity", "shop"])).first()[0]
    assert text == "chez x fast food bakery cafe outdoor seating rue a 75001"


def test_allocate():
    assert sampling.allocate(11, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 4, "c": 3}
    assert sampling.allocate(10, {"A": 0.1, "B": 0.3, "C": 0.6}) == {"A": 1, "B": 3, "C": 6}
    with pytest.raises(ZeroDivisionError):
        sampling.allocate(1, {"a": 0})


def test_questions_negatives_and_sets(spark):
    places = spark.createDataFrame([(1, "cafe", "thai", "yes", None), (2, "cafe", None, "no", None), (3, "bar", "thai", "yes", "yes"), (4, None, "nan", None, None)], "poi_id long, category string, cooking_type string, outdoor_seating string, indoor_seating string")
    asked = {tuple(r["question"]): r for r in semantic.questions(places).collect()}
    assert (asked[("category cafe",)]["nb_answer"], asked[("category cafe",)]["first_poi"]) == (2, 1) and len(asked) == 7 + 3 + 15 - 4
    assert asked[("cooking_type thai", "with outdoor seating")]["features"] == {"cooking_type": "thai", "outdoor_seating": "yes"}
    one = spark.createDataFrame([("q", {"category": "cafe", "cooking_type": "thai"}), ("r", {"category": "bar"})], "question_id string, features map<string,string>")
    got = sorted((r["question_id"], r["poi_id"], r["n_matched"]) for r in semantic.count_matches(one, places).collect())
    assert got == [("q", 1, 2), ("q", 2, 1), ("q", 3, 1), ("r", 3, 1)]
    sets = semantic.train_test(places, ratio_test=0.25, n_hard=1).collect()
    assert len({r["question_id"] for r in sets if r["is_test"]}) == len(asked) // 4
    assert not any(r["is_test"] and r["kind"] == "hard" for r in sets)
    batches = spark.createDataFrame([(1, [["category cafe"]], [2, 3, 3, None])], "batch_id long, questions array<array<string>>, poi_ids array<long>")
    ids = semantic.redraw_answers(batches, semantic.question_places(places), 1).first()["poi_ids"]
    assert len(ids) == 2 and ids[0] in (1, 2) and ids[1] == 3


def test_extracts(spark, tmp_path):
    elements = spark.createDataFrame([(1, 2.35, 48.85, "A", "cafe", "Japanese;bar"), (2, 2.35, 48.85, None, "cafe", None), (3, 9.0, 48.85, "C", "bar", None), (4, 2.3, 48.85, "D", "bench", None)], "osm_id long, lon double, lat double, name string, amenity string, cuisine string")
    got = extracts.places(elements, bbox=(2.24, 48.8, 2.41, 48.9)).collect()
    assert [(r["poi_id"], r["category"], r["cooking_type"], r["bow_poi"]) for r in got] == [(1, "cafe", "japanese", "cafe japanese"), (4, "unknown", None, "unknown")]
    rings = "rings array<array<struct<x:double,y:double>>>"
    areas = spark.createDataFrame([(2, "P", "x", "park", [[(0.0, 0.0)]]), (1, "P", "9", "park", [[(0.0, 0.0)]]), (3, "Q", "8", None, [[(0.0, 0.0)]]), (4, None, None, None, [[(0.0, 0.0)]])], f"osm_id long, name string, admin_level string, leisure string, {rings}")
    assert [(r["area_id"], r["category"]) for r in extracts.named_areas(areas).collect()] == [(1, "park")]
    lines = [(1, "S", [[(0.0, 0.0), (10.0, 0.0)]]), (2, "S", [[(10.0, 0.0), (20.0, 0.0)]]), (3, "S", [[(110.0, 0.0), (130.0, 0.0)]]), (4, "S", [[(500.0, 0.0), (510.0, 0.0)]]), (5, None, [[(0.0, 0.0), (1.0, 1.0)]])]
    streets = extracts.named_streets(spark.createDataFrame(lines, "osm_id long, name string, parts array<array<struct<x:double,y:double>>>"))
    assert sorted((r["id_street"], [[p["x"] for p in part] for part in r["parts"]]) for r in streets.collect()) == [(1, [[110.0, 130.0], [0.0, 10.0, 20.0]]), (4, [[500.0, 510.0]])]


def test_boxes_listings_and_texts(spark, tmp_path):
    assert extracts.bbox_to_polygon((1, 2, 3, 4)) == [[(1, 2), (3, 2), (3, 4), (1, 4), (1, 2)]]
    listing = [(1, 48.85, 2.35, False), (2, 48.85, 2.35, True), (3, 10.0, 2.35, False)]
    spark.createDataFrame(listing, "id long, latitude double, longitude double, permanently_closed boolean").write.json(f"{tmp_path}/listing")
    assert [r["id"] for r in extracts.listed_places(spark, f"{tmp_path}/listing", (2.24, 48.8, 2.41, 48.9), ["id"]).collect()] == [1]
    elements = spark.createDataFrame([(1, 2.35, 48.85, "Chez_X", "cafe", "yes"), (2, 9.0, 48.85, "Y", "bar", None)], "osm_id long, lon double, lat double, name string, amenity string, outdoor_seating string")
    assert [r["text"] for r in extracts.element_text(elements).orderBy("osm_id").collect()] == ["chez x cafe outdoor seating", "y bar"]
    assert [r["poi_id"] for r in extracts.places(elements, bbox="all").collect()] == [1]


def test_storable_columns_and_sets(spark, tmp_path):
    rows = spark.range(2).select("id", F.lit(None).alias("nothing"))
    extracts.storable(rows).write.parquet(f"{tmp_path}/stored")
    assert spark.read.parquet(f"{tmp_path}/stored").count() == 2
    sets = spark.createDataFrame([("q", False, "positive", 1), ("q", False, "hard", 2), ("r", True, "positive", 3)], "question_id string, is_test boolean, kind string, poi_id long")
    Q.save_train_test(sets, f"{tmp_path}/sets", {"seed": 1, "n_hard": 2})
    assert spark.read.parquet(f"{tmp_path}/sets/train_set.parquet").count() == 2
    assert spark.read.parquet(f"{tmp_path}/sets/test_set.parquet").columns == ["question_id", "poi_id"]
    assert json.loads(Q.read_text(spark, f"{tmp_path}/sets/config.json")) == {"n_hard": 2}


def test_examples_of_every_check(spark):
    found = spark.createDataFrame([(i, c, 1) for i in range(9) for c in ("a", "b")], "question_id long, check string, n long")
    assert sorted((r["check"], r["question_id"]) for r in validate.examples(found, 2).collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_lines_of_one_name_are_joined_by_chains(spark):
    pieces = [(i, "Long", [[(30.0 * i, 0.0), (30.0 * i + 20.0, 0.0)]]) for i in range(40)] + [(99, "Long", [[(5000.0, 0.0), (5010.0, 0.0)]]), (50, "Other", [[(0.0, 1.0), (5.0, 1.0)]]), (60, "Long", [[(1.0, 1.0)]])]
    lines = spark.createDataFrame(pieces, "osm_id long, name string, parts array<array<struct<x:double,y:double>>>")
    got = {r["id_street"]: (r["street_name"], len(r["parts"])) for r in extracts.named_streets(lines).collect()}
    assert got == {0: ("Long", 40), 99: ("Long", 1), 50: ("Other", 1)}
    assert extracts.named_streets(lines.limit(0)).count() == 0
