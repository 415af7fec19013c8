"""Hard negatives, against all places one by one."""

from conftest import OSM

from terramill.operators import corpus, semantic
from terramill.plans import attributes

POIS = [{"poi_id": 7 * i % 101, "category": ["cafe", "bar", "pub"][i % 3] if i % 11 else None, "cooking_type": "thai" if i % 5 == 0 else None, "outdoor_seating": "yes" if i % 4 else "no"} for i in range(60)]


def brute(constraints, places):
    """Places with one constraint less than all."""
    return {p["poi_id"] for p in places if sum(p[k] == v for k, v in constraints.items()) == len(constraints) - 1}


def test_training_questions_of_one_attribute_have_hard_negatives(tables):
    places = corpus.pois(tables.make(OSM, POIS)).cache()
    rows = places.collect()
    asked = {r["question_id"]: r for r in semantic.questions(places).collect()}
    for n_hard in (3, 1000):
        found = semantic.train_test(places, n_hard=n_hard).collect()
        test = {r["question_id"] for r in found if r["is_test"]}
        hard = {}
        for r in found:
            if r["kind"] == "hard":
                hard.setdefault(r["question_id"], []).append(r["poi_id"])
        assert len([q for q in hard if asked[q]["nb_feature"] == 1]) >= 4
        for q, r in asked.items():
            expected, got = brute(r["features"], rows) if q not in test else set(), hard.get(q, [])
            assert len(got) == len(set(got)) == min(n_hard, len(expected)) and set(got) <= expected, r["question"]


def test_hard_negatives_that_lack_two_constraints(tables):
    places = corpus.pois(tables.make(OSM, POIS)).cache()
    rows, long = places.collect(), semantic.question_places(places)
    asked = semantic.questions(places).where("nb_feature = 3")
    got = {}
    for r in semantic.drawn_hard_negatives(asked, long, places, 1000, nb_unmatches=2).collect():
        got.setdefault(r["question_id"], set()).add(r["poi_id"])
    for q in asked.collect():
        assert got.get(q["question_id"], set()) == {p["poi_id"] for p in rows if 1 <= sum(p[k] == v for k, v in q["features"].items()) < 3}


def test_hard_negatives_of_all_questions(spark, tables, tmp_path):
    tables.make(OSM, POIS).write.parquet(f"{tmp_path}/df_osm.parquet")
    places = corpus.pois(tables.make(OSM, POIS)).cache()
    rows = places.collect()
    expected = {}
    for r in semantic.questions(places).collect():
        if others := brute(r["features"], rows):
            expected["|".join(r["question"])] = (len(others), min(others), max(others))
    assert {r["question"]: (r["n_hard"], r["first_poi"], r["last_poi"]) for r in attributes.hard_negatives(spark, str(tmp_path)).collect()} == expected
